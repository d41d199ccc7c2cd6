"""Best-fit packing with certified bin counts: partitions that miss their lower bound exchange documents and pack again.

Documents become token pieces of at most `capacity` ids. Pieces are dealt to partitions of bounded size by a hash of a row id, each
partition runs best-fit decreasing and certifies its bin count with dual-feasible-function lower bounds. Pieces of bins with room are
dealt anew among all partitions with a gap and repacked, until the total meets the bound of the whole input or stops falling.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import DOCUMENT_COLUMNS, cut, table

CAPACITY = 4096
#: Pieces dealt to one packing task, on average.
PIECES_PER_TASK = 1 << 16
#: Words kept by a Python worker with their ids; beyond it the store starts anew.
KEPT_WORDS = 1_000_000
END_ID = 1
#: Plain words, with one closing mark: the mark is a token of its own, and case folds letter by letter.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
TEXTS_AT_ONCE = 32


class WordIds:
    """Ids of whole texts by words: the vocabulary never joins across white space, so ids of a word are kept and reused."""

    def __init__(self, file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.any = Tokenizer.from_file(public_tokenizers.path(file))
        # plain words come in lower case and are one piece, so neither normaliser nor pattern has work to do
        self.plain = Tokenizer.from_file(public_tokenizers.path(file))
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.wide, self.code = ("<u2", "H") if self.any.get_vocab_size() < 1 << 16 else ("<u4", "I")
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, words: set[str]) -> None:
        known, plain, other = self.known, {}, []
        for w in words:
            if m := PLAIN.fullmatch(w):
                plain[w] = (m[1].lower(), m[2])
            else:
                other.append(w)
        heads = [h for h in {h for h, _ in plain.values()} if h not in known]
        other += [mark for mark in ".," if mark not in known]
        for tokenizer, new in ((self.plain, heads), (self.any, other)):
            for word, enc in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[word] = array(self.code, enc.ids).tobytes()
        for w, (head, mark) in plain.items():
            known[w] = known[head] + known[mark] if mark else known[head]

    def encode(self, texts: list[str]):
        """Ids of each text, as little-endian 32-bit integers."""
        known = self.known
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for t in texts[at:at + TEXTS_AT_ONCE]]
            if len(known) > KEPT_WORDS:
                known.clear()
                known[""] = b""
            self.learn({w for words in split for w in words if w not in known})
            for words in split:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)), self.wide).astype("<u4")


@lru_cache(maxsize=2)
def word_ids(file: str) -> WordIds:
    return WordIds(file)


def token_pieces(docs: DataFrame, keys: list[str], text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, file: str = "word_bpe_49k.json") -> DataFrame:
    """`keys`, piece, start, length, ids_crc32: each document's ids with `end_id` behind, cut into pieces of at most `capacity`.

    Null and empty texts are the end id alone. Texts are encoded whole; repeated rows give repeated pieces.
    """
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = (rows.drop("__text").withColumn("piece", F.lit(0)).withColumn("start", F.lit(0).cast("long")).withColumn("length", F.lit(0).cast("long"))
              .withColumn("ids_crc32", F.lit(0).cast("long")).schema)
    end = np.array([end_id], "<u4")

    def run(batches):
        enc = word_ids(file)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode(b.column("__text").to_pylist())):
                ids = np.concatenate([ids, end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in keys], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                                              pa.array(crc, pa.int64())], names=[*keys, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's free room of each length. Free rooms that exist are bits of one integer, so a fit is one shift."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    room: list[int] = []
    bits = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                bits &= ~(1 << free)
        else:
            free, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - free
        room[b] = free - n
        if free > n:
            open_bins.setdefault(free - n, []).append(b)
            bits |= 1 << (free - n)
    return bins, offsets, np.asarray(room, np.int64)[bins] if len(lengths) else bins


def bin_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Largest lower bound over two families of dual-feasible functions, for `counts` pieces of each of the distinct `sizes`."""
    if not len(sizes):
        return 0
    total = np.zeros(capacity + 2, np.int64)
    number = np.zeros(capacity + 2, np.int64)
    np.add.at(number, sizes, counts)
    total = np.cumsum(number * np.arange(capacity + 2))
    number = np.cumsum(number)
    best = -(-int(total[capacity]) // capacity)
    for a in range(1, capacity // 2 + 1):  # above capacity - a: a whole bin; below a: nothing; else itself
        large = int(number[capacity] - number[capacity - a])
        middle = int(total[capacity - a] - total[a - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 64):  # floor((k + 1) x) / k, and x itself where (k + 1) x is whole
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def pack_once(pieces: DataFrame, parts: int, round_no: int, capacity: int) -> DataFrame:
    """One round: every partition packed and certified. Adds sequence_id, offset, room (of the bin), part, part_bins, part_bound."""
    own = ["sequence_id", "offset", "room", "part", "part_bins", "part_bound"]
    base = pieces.drop(*own).withColumn("part", F.pmod(F.xxhash64("row_id", F.lit(round_no)), F.lit(parts)).cast("long"))
    schema = base.select("*", *[F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", "room", "part_bins", "part_bound")]).schema

    def run(t: pa.Table) -> pa.Table:
        lengths, part = t.column("length").to_numpy(), t.column("part")[0].as_py()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        sizes, counts = np.unique(lengths, return_counts=True)
        n = int(bins.max()) + 1
        ids = (round_no << 52) + (part << 24) + bins
        for name, col in (("sequence_id", ids), ("offset", offsets), ("room", room), ("part_bins", np.full(len(bins), n)), ("part_bound", np.full(len(bins), bin_bound(sizes, counts, capacity)))):
            t = t.append_column(name, pa.array(col, pa.int64()))
        return t

    return base.groupBy("part").applyInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK, max_rounds: int = 8) -> tuple[DataFrame, dict]:
    """Packed pieces (input columns plus sequence_id, offset) and the certificate {bins, bound, rounds}.

    Needs a column `length` (1 to capacity). Each round keeps the bins without room and the partitions that need no exchange; of the rest the
    pieces are dealt anew. A round that does not lower the count is dropped, and the second such round in turn ends the work. Only a histogram of at most `capacity` lengths and
    one row of totals reach the driver.
    """
    rows = cut(pieces.withColumn("row_id", F.monotonically_increasing_id()))
    hist = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()
    bound = bin_bound(hist["length"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), capacity)
    n = int(hist["n"].sum())
    parts = max(1, -(-n // per_task))
    done = cut(pack_once(rows, parts, 0, capacity))
    bins, rounds, idle = _bins(done), 1, 0
    while bins > bound and rounds < max_rounds and idle < 2:
        gap = F.col("room") > 0
        loose = done.where(gap)
        m, old = loose.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        parts_now = max(1, -(-m // per_task))
        if parts_now == 1 and (idle or parts == 1):  # the same pieces in one task again would give the same bins
            break
        again = cut(pack_once(loose, parts_now, rounds, capacity))
        new, rounds = _bins(again), rounds + 1
        if new >= old:
            idle += 1
            continue
        done = done.where(~gap).unionByName(again)
        bins, parts, idle = bins - old + new, parts_now, 0
    out = done.drop("row_id", "room", "part", "part_bins", "part_bound")
    return out, {"bins": bins, "bound": bound, "rounds": rounds}


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("part").agg(F.max("part_bins").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = pack(token_pieces(table(spark, sf_dir, "documents"), ["doc_id"]))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document of its input as packed pieces."""
    packed, _ = pack(token_pieces(docs.select(*DOCUMENT_COLUMNS), ["doc_id"]))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
