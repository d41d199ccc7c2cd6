"""Helpers shared by the operators: table reads, written cuts, text windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.session import ensure_checkpoint_dir

SEED = 42
#: Bits of a filter of keys, in words of 2^15 bits.
FILTER_BITS = 1 << 26
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written once below the shared checkpoint folder and read back.

    Unlike checkpoint() the reread plan has no partitioning of its own, so a later join shuffles both sides and
    adaptive execution can split a hot key; only the columns a reader needs are read.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_batches(batches: Iterator, columns: list[str], text: str) -> Iterator[tuple[dict[str, list], list[str]]]:
    """Arrow batches as Python lists of the key columns plus the texts (null: empty)."""
    for b in batches:
        if b.num_rows:
            yield {c: b.column(c).to_pylist() for c in columns}, [t or "" for t in b.column(text).to_pylist()]


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of so many words, repeats included, in parts; a shorter text is one run. Words end at white space, capitals A to Z don't count."""
    from xxhash import xxh64_intdigest

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    width = min(words, len(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(tokens) - width + 1
    for at in range(0, n, 1 << 16):
        till = min(n, at + (1 << 16))
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:till].tolist(), ends[at + width - 1:till + width - 1].tolist())), np.uint64, till - at)


def by_whole_groups(batches: Iterator, group: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """`work` on the whole groups of sorted batches; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in group]
        first = int(np.flatnonzero(np.logical_and.reduce([c == c[-1] for c in cols]))[0])
        if first or held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in group):
            whole = [*held, b.slice(0, first)] if first else held
            yield from work(pa.Table.from_batches(whole))
            held = []
        held.append(b.slice(first))
    if held:
        yield from work(pa.Table.from_batches(held))


def in_block_pairs(rows: DataFrame, count: str, block_rows: int) -> DataFrame:
    """`rows` (with `node` and the row count of their group) with block, lo, hi: a group beyond `block_rows` is dealt into blocks, and each pair of
    blocks lo <= hi gets the rows of both, so that no piece of work holds more than two blocks."""
    rows = rows.withColumn("__blocks", F.coalesce(F.ceil(F.col(count) / F.lit(block_rows)), F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("__blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__other"))
    return rows.select("*", F.least("block", "__other").alias("lo"), F.greatest("block", "__other").alias("hi")).drop("__blocks", "__other", count)


def _bit(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, *cols: str) -> DataFrame:
    """Bitmaps (__word, __bits) of the hashes of `cols`: at most 8 MB in all, so that every task may have them."""
    bits = keys.select(_bit(*cols).alias("__bit")).distinct()
    words = bits.select(F.shiftright("__bit", 15).alias("__word"), (F.col("__bit") % (1 << 15)).alias("__at")).repartition("__word")
    return cut(words.groupBy("__word").agg(F.bitmap_construct_agg("__at").alias("__bits")))


def marked(rows: DataFrame, bits: DataFrame, *cols: str) -> DataFrame:
    """`rows` where they lie, with __may: false only if no key of the filter equals `cols`, which must have the types of its columns."""
    own = rows.withColumn("__bit", _bit(*cols))
    met = own.join(F.broadcast(bits), F.shiftright("__bit", 15) == F.col("__word"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(F.col("__bit") % (1 << 15), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0, F.lit(False))
    return met.select(*rows.columns, may.alias("__may"))


def held(rows: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """The rows that may be among `keys` by `cols` (columns of both): a join with the keys need not shuffle the others."""
    return marked(rows, key_filter(keys, *cols), *cols).where("__may").drop("__may")


def without_texts(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` without those of `gone` (__id, __sha: the hash of the text; null ids are equal). Texts that the filter of `gone` parts from it stay where they are."""
    own = marked(rows.withColumn("__own", F.sha2(text_or_empty().cast("binary"), 256)), key_filter(gone, "__id", "__sha"), "doc_id", "__own")
    left = own.where("__may").join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_anti")
    return own.where("not __may").unionByName(left).select(*rows.columns)
