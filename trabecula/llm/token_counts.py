"""Exact length histogram: one row per encoded length, suffix sums answer every context limit."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trabecula.llm.common import table

#: Lengths per bucket of the two-level suffix sums.
BUCKET = 4096
#: Texts above this many characters are encoded piece by piece.
CHUNK = 1 << 20
#: A space between a letter or digit and a letter always starts a token, so a text may be cut there.
SAFE_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W\d_])")


@lru_cache(maxsize=2)
def encoder(ranks_file: str):
    """Byte-level BPE of a rank file; special strings in a text are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(enc, text: str) -> int:
    total, at = 0, 0
    while len(text) - at > CHUNK:
        found = SAFE_CUT.search(text, at + CHUNK)
        if not found:
            break
        total += len(enc.encode_ordinary(text[at:found.start()]))
        at = found.start()
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def encoded_lengths(docs: DataFrame, keys: list[str], text: str = "text", ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """`keys` and the encoded length `n_tokens` of each whole text (null or empty: 0)."""
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = rows.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches):
        enc = encoder(ranks_file)
        for b in batches:
            n = [encoded_length(enc, t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    return rows.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame, length: str = "n_tokens", by: list[str] = ()) -> DataFrame:
    """One row per length: documents and tokens, combined before the shuffle."""
    return lengths.groupBy(*by, F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("docs")).withColumn("tokens", F.col("length") * F.col("docs"))


def suffix_sums(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds, per length L, what every context limit L needs.

    docs_le, tokens_le: documents of at most L tokens; docs_gt, tokens_gt: longer ones; truncated_tokens: total when each document
    is cut to L; lost_tokens: what that cut drops; quantile: share of documents of at most L. Sums run inside buckets of lengths and
    bucket totals are added, so the longest sort holds BUCKET lengths. Rows are lengths, never documents.
    """
    b = [*by, "__b"]
    rows = hist.withColumn("__b", F.floor(F.col("length") / BUCKET))
    later = Window.partitionBy(*by).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    sums = rows.groupBy(*b).agg(F.sum("docs").alias("__d"), F.sum("tokens").alias("__t"))
    sums = sums.select(*b, F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__d_later"), F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__t_later"),
                       F.sum("__d").over(every).alias("all_docs"), F.sum("__t").over(every).alias("all_tokens"))
    inside = Window.partitionBy(*b).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    keyed = sums.select([F.col(c).alias(f"__k_{c}") if c in b else F.col(c) for c in sums.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in b]
    out = (rows.withColumn("__di", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("__ti", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
           .join(keyed, same).withColumn("docs_gt", F.col("__di") + F.col("__d_later")).withColumn("tokens_gt", F.col("__ti") + F.col("__t_later")))
    lost = F.col("tokens_gt") - F.col("length") * F.col("docs_gt")
    return out.select(*by, "length", "docs", "tokens", (F.col("all_docs") - F.col("docs_gt")).alias("docs_le"), (F.col("all_tokens") - F.col("tokens_gt")).alias("tokens_le"),
                      "docs_gt", "tokens_gt", (F.col("all_tokens") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"),
                      ((F.col("all_docs") - F.col("docs_gt")) / F.col("all_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for stated limits that need not be lengths: the sums of the largest length at or below each limit, extended to the limit."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.max("docs_le").alias("all_docs"), F.max("tokens_le").alias("all_tokens"))
    picks = [F.max(F.when(F.col("length") <= x, F.struct("length", "docs_le", "tokens_le"))).alias(f"p{x}") for x in limits]
    best = sums.agg(*picks).select(F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context_limit"), F.col(f"p{x}").alias("p")) for x in limits])).alias("r"))
    d, t = F.coalesce("r.p.docs_le", F.lit(0)), F.coalesce("r.p.tokens_le", F.lit(0))
    total_row = total.withColumn("__one", F.lit(1))
    return (asked.join(best.select(F.col("r.context_limit").alias("context_limit"), d.alias("docs_le"), t.alias("tokens_le")), "context_limit").withColumn("__one", F.lit(1))
            .join(total_row, "__one").withColumn("truncated_tokens", F.col("tokens_le") + F.col("context_limit") * (F.col("all_docs") - F.col("docs_le")))
            .drop("__one", "all_tokens", "all_docs"))


def length_at(sums: DataFrame, probability: float) -> DataFrame:
    """Smallest length that at least `probability` of the documents do not exceed."""
    return sums.where(F.col("quantile") >= probability).agg(F.min("length").alias("length"))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), [])
    return suffix_sums(length_histogram(lengths)).withColumn("quantile", F.round("quantile", 9))
