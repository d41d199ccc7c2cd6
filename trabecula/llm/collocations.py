"""Phrase collocations from one bidirectional FM-index per shard over word ids.

Texts are cut into pieces and words, and each task turns runs of its texts (of one language) into shards. A shard keeps its word list and two
Burrows-Wheeler transforms over local word ids, of the text and of the reversed text, both sorted to the depth of the longest phrase. A phrase
is an interval in each: extending it to the left groups the symbols of its forward interval and moves both intervals along, to the right likewise
in the backward one. Phrases grow one word at a time. Their counts are summed across shards, and only phrases that reach the
least count over all shards are extended, since no longer phrase is more frequent than its parts.

Frequent words get numbers that all shards share. A shard deals its phrases, as word numbers, into buckets by hash and packs each bucket in order of the
words, so that a phrase costs a few bytes in the shuffle; the sums of a bucket are made in one group.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trabecula.llm.common import cut, table

DEPTH = 4
#: Words of one shard, and bytes of a text that are cut into words at once (at the end of a piece).
SHARD_WORDS, TEXT_BYTES = 1 << 20, 1 << 22
#: Words of text for which there is a bucket of phrases.
BUCKET_WORDS = 1 << 21
#: Least count of a phrase; a phrase goes if a longer one has this share of its occurrences; phrases reported per language.
LEAST, SHARE, TOP = 30, 80, 2000
#: Parts in which a language's best phrases are found before they are ranked together.
RANK_PARTS = 64

_STOP = b"."
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _STOP * 9)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_ids(data: bytes, known: _Ids) -> Iterator[np.ndarray]:
    """Ids of a text's words in parts, a 0 at the end of each piece; `known` has the stop as 0."""
    data, at = data.translate(_CLEAN), 0
    while at < len(data):
        end = data.find(_STOP, at + TEXT_BYTES)
        end = len(data) if end < 0 else end + 1
        words = data[at:end].replace(_STOP, b" . ").split()
        yield np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        at = end


def _transform(ids: np.ndarray) -> np.ndarray:
    """Symbols ahead of the suffixes sorted by their first DEPTH symbols."""
    n = len(ids)
    ahead = np.zeros(n + DEPTH, np.uint64)
    ahead[:n] = ids
    pairs = ahead[:-1] << np.uint64(32) | ahead[1:]
    return np.r_[np.int32(0), ids[:-1]][np.lexsort((pairs[2:2 + n], pairs[:n]))]


@dataclass
class Phrases:
    """Intervals of phrases of one length: words (columns of local ids), starts in both indexes, counts."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases(self.words[:, which], self.forward[which], self.backward[which], self.count[which])


class Index:
    """Bidirectional FM-index of one shard; symbol 0 stands between pieces and is in no phrase."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, symbols: int):
        self.symbols = symbols
        self.first = np.r_[0, np.cumsum(np.bincount(forward, minlength=symbols))]
        self.ahead = [forward, backward]
        self.moved: list[np.ndarray | None] = [None, None]

    def _last_to_first(self, side: int) -> np.ndarray:
        if self.moved[side] is None:
            order = np.argsort(self.ahead[side], kind="stable")
            self.moved[side] = np.empty(len(order), np.int64)
            self.moved[side][order] = np.arange(len(order))
        return self.moved[side]

    def single(self, words: np.ndarray) -> Phrases:
        at = self.first[words]
        return Phrases(words[None, :], at, at.copy(), self.first[words + 1] - at)

    def extend(self, phrases: Phrases, left: bool) -> Phrases:
        """All phrases one word longer, in order of the phrase and the new word."""
        side = 0 if left else 1
        own, other = (phrases.forward, phrases.backward) if left else (phrases.backward, phrases.forward)
        total = int(phrases.count.sum())
        which = np.repeat(np.arange(len(own)), phrases.count)
        rows = np.arange(total) - np.repeat(np.cumsum(phrases.count) - phrases.count, phrases.count) + own[which]
        keys, seen, count = np.unique(which * self.symbols + self.ahead[side][rows], return_index=True, return_counts=True)
        which, word = keys // self.symbols, keys % self.symbols
        before = np.cumsum(count) - count  # phrases with smaller words stand ahead in the other index
        before -= (np.cumsum(phrases.count) - phrases.count)[which]
        moved, beside = self._last_to_first(side)[rows[seen]] if total else rows, other[which] + before
        keep = word > 0
        longer = np.vstack([word[None, :], phrases.words[:, which]] if left else [phrases.words[:, which], word[None, :]])
        return Phrases(longer, moved if left else beside, beside if left else moved, count).take(keep)


def _packed(ids: np.ndarray) -> bytes:
    """Ids as two planes of 16 bits, deflated: the upper one is nearly empty."""
    return zlib.compress(np.r_[(ids & 0xFFFF).astype("<u2"), (ids >> 16).astype("<u2")].tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(data), "<u2").reshape(2, -1).astype(np.int32)
    return low | high << 16


def _marks(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def _marked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n, bitorder="little").astype(bool)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (columns of word numbers) in order of their bucket and words, the buckets met, and where each starts and ends in that order."""
    mixed = np.zeros(keys.shape[1], np.uint64)
    for k in keys:
        mixed = (mixed ^ k.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((*keys[::-1], bucket))
    met, first = np.unique(bucket[order], return_index=True)
    return order, met, np.r_[first, len(order)]


def _packed_phrases(keys: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted phrases and their counts as planes of bytes, deflated; of the first word only the steps."""
    rows = np.vstack([np.diff(keys[0], prepend=0), *keys[1:], count]).astype("<u4")
    return zlib.compress(rows.view(np.uint8).reshape(*rows.shape, 4).transpose(0, 2, 1).tobytes(), 1)


def _unpacked_phrases(data: bytes, words: int) -> np.ndarray:
    """Columns of word numbers and counts."""
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(words + 1, 4, -1).transpose(0, 2, 1)
    rows = np.ascontiguousarray(rows).view("<u4")[:, :, 0].astype(np.int64)
    rows[0] = np.cumsum(rows[0])
    return rows


_INDEX = "shard long, lang string, n long, words array<string>, counts array<long>, forward binary, backward binary"


def build_indexes(docs: DataFrame, shard_words: int = SHARD_WORDS, lang: str = "lang", text: str = "text") -> DataFrame:
    """One row per shard: its language, number of words, word list with counts (from local id 1), and both transforms."""

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def flush(name: str) -> pa.RecordBatch:
            nonlocal made
            known, parts = held.pop(name)
            del sizes[name]
            ids = np.concatenate([np.zeros(1, np.int32), *parts])
            counts = np.bincount(ids, minlength=len(known))[1:]
            made += 1
            words = [w.decode("utf-8", "replace") for w in known][1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([name]), pa.array([int(counts.sum())]), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([_packed(_transform(ids))], pa.binary()), pa.array([_packed(_transform(ids[::-1]))], pa.binary())],
                names=["shard", "lang", "n", "words", "counts", "forward", "backward"])

        for b in batches:
            for name, data in zip(b.column("lang").to_pylist(), b.column("data").to_pylist()):
                known, parts = held.setdefault(name, (_Ids({_STOP: 0}), []))
                new = [*word_ids(data, known), np.zeros(1, np.int32)]
                parts += new
                sizes[name] = sizes.get(name, 0) + sum(map(len, new))
                if sizes[name] >= shard_words:
                    yield flush(name)
        for name in list(held):
            yield flush(name)

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, _INDEX)


def _indexes(batches: Iterator) -> Iterator[tuple[dict, Index, np.ndarray, np.ndarray]]:
    """Row, index, frequent words and the shared numbers of all words of each shard."""
    for b in batches:
        for row in range(b.num_rows):
            forward = _unpacked(b.column("forward")[row].as_py())
            index = Index(forward, _unpacked(b.column("backward")[row].as_py()), int(forward.max()) + 1)
            place, number = (x.to_numpy() for x in b.column("frequent")[row].values.flatten())
            ids = np.zeros(index.symbols, np.int64)
            ids[place] = number
            yield {c: b.column(c)[row] for c in b.schema.names if c in ("shard", "pairs")}, index, place, ids


def _pairs(index: Index, frequent: np.ndarray) -> Phrases:
    """Pairs of frequent words, extended to the left."""
    ok = np.zeros(index.symbols, bool)
    ok[frequent] = True
    pairs = index.extend(index.single(frequent), True)
    return pairs.take(ok[pairs.words[0]])


_DEALT = "shard long, size int, bucket int, data binary"


def _deal(shard: int, keys: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    order, met, ends = _dealt(keys, buckets)
    keys, count = keys[:, order], count[order]
    data = [_packed_phrases(keys[:, a:b], count[a:b]) for a, b in pairwise(ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(met), shard, np.int64)), pa.array(np.full(len(met), len(keys), np.int32)), pa.array(met), pa.array(data, pa.binary())],
                                      names=["shard", "size", "bucket", "data"])


def _deal_pairs(buckets: int) -> Callable:
    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for row, index, frequent, ids in _indexes(batches):
            pairs = _pairs(index, frequent)
            yield _deal(row["shard"].as_py(), ids[pairs.words], pairs.count, buckets)

    return run


def _deal_longer(buckets: int) -> Callable:
    """Phrases of three and four words whose pairs are all frequent: pairs to the right, then to the left."""
    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        for row, index, frequent, ids in _indexes(batches):
            pairs = _pairs(index, frequent)
            order, met, ends = _dealt(ids[pairs.words], buckets)
            keep = np.zeros(len(order), bool)
            for x in row["pairs"].as_py():
                at = np.searchsorted(met, x["bucket"])
                own = order[ends[at]:ends[at + 1]]
                keep[own] = _marked(x["marks"], len(own))
            pairs = pairs.take(np.flatnonzero(keep))
            known = np.sort(pairs.words[0].astype(np.int64) * index.symbols + pairs.words[1])

            def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                key = left.astype(np.int64) * index.symbols + right
                return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key if len(known) else np.zeros(len(key), bool)

            grown = index.extend(pairs, False)
            grown = grown.take(joined(grown.words[1], grown.words[2]))
            for part in (grown, index.extend(grown, True)):
                part = part.take(joined(part.words[0], part.words[1]))
                yield _deal(row["shard"].as_py(), ids[part.words], part.count, buckets)

    return run


_SUMS = "shard long, bucket int, marks binary, ids array<long>, f long"


def _sums(least: int) -> Callable:
    """Of a bucket: the phrases with f >= `least` (ids, f), and for each shard's pairs (shard, bucket, marks) which of them are among these."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        size = key[0].as_py()
        parts = [_unpacked_phrases(x, size) for x in t.column("data").to_pylist()]
        rows = np.hstack(parts)
        order = np.lexsort(rows[size - 1::-1])
        first = np.r_[True, (np.diff(rows[:size, order], axis=1) != 0).any(axis=0)]
        f = np.add.reduceat(rows[size, order], np.flatnonzero(first))
        ids = rows[:size, order[first][f >= least]].T
        n = len(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.array(ids.ravel()))
        none = [pa.nulls(n, x) for x in (pa.int64(), pa.int32(), pa.binary())]
        out = [pa.Table.from_arrays([*none, lists, pa.array(f[f >= least])], names=["shard", "bucket", "marks", "ids", "f"])]
        if size == 2:
            good = np.empty(len(order), bool)
            good[order] = (f >= least)[np.cumsum(first) - 1]
            marks = [_marks(x) for x in np.split(good, np.cumsum([p.shape[1] for p in parts])[:-1])]
            n = len(marks)
            out.append(pa.Table.from_arrays([t.column("shard"), t.column("bucket"), pa.array(marks, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=out[0].column_names))
        return pa.concat_tables(out)

    return run


def _numbered(words: DataFrame) -> DataFrame:
    """`words` with `id`: numbers from 0 without gaps, in order of the parts the rows are written in."""
    rows = cut(words.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id() % (1 << 33)}))
    parts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row per part
    starts = parts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__start"))
    return cut(rows.join(starts, "__p").withColumn("id", F.col("__start") + F.col("__i")).drop("__p", "__i", "__start"))


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, lang: str = "lang", text: str = "text", bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of one to DEPTH words with f >= `least`, and (lang, n) with the words of each language.

    Words and pairs go in a round each; longer phrases are enumerated once their pairs are known. Every round has one shuffle, of words or of packed buckets;
    what survives goes back to its shards, pairs as bits. Null texts count as empty, a null language is `und`;
    texts of any length are read whole. Other columns are not read.
    """
    spark = docs.sparkSession
    # buckets by shard: the rounds bring their bits to the indexes, which are never shuffled
    name = f"phrase_index_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = build_indexes(docs, shard_words, lang, text)
    made.write.bucketBy(parts, "shard").saveAsTable(name)
    index = spark.table(name)
    totals = cut(index.groupBy("lang").agg(F.sum("n").cast("long").alias("n")))
    buckets = max(parts, -(-(totals.agg(F.sum("n")).first()[0] or 0) // bucket_words))
    listed = index.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("p", "w")).select(
        "shard", "lang", (F.col("p") + 1).alias("place"), F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))

    total = F.sum("n").over(Window.partitionBy("lang", "phrase")).cast("long")
    words = cut(listed.withColumn("f", total).where(F.col("f") >= least).select("shard", "place", "lang", "phrase", "f"))
    singles = _numbered(words.groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    own = words.select("shard", "place", "lang", "phrase").join(singles.drop("f"), ["lang", "phrase"])
    own = cut(own.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("frequent")))  # a shard has a bounded number of words
    known = index.select("shard", "forward", "backward").join(own, "shard")

    def summed(dealt: DataFrame) -> DataFrame:
        return cut(dealt.groupBy("size", "bucket").applyInArrow(_sums(least), _SUMS))

    pairs = summed(known.mapInArrow(_deal_pairs(buckets), _DEALT))
    marks = cut(pairs.where(F.col("marks").isNotNull()).groupBy("shard").agg(F.collect_list(F.struct("bucket", "marks")).alias("pairs")))
    longer = summed(known.join(marks, "shard").mapInArrow(_deal_longer(buckets), _DEALT))
    phrases = pairs.unionByName(longer).where(F.col("ids").isNotNull()).select("ids", "f")
    spelt = phrases.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(singles.drop("f"), "id").groupBy("ids", "f").agg(
        F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "phrase"))).alias("words"))
    counts = cut(singles.drop("id").unionByName(spelt.select("lang", F.array_join("words.phrase", " ").alias("phrase"), "f")))
    spark.sql(f"DROP TABLE {name}")
    return counts, totals


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, shard_words: int = SHARD_WORDS, lang: str = "lang", text: str = "text") -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the language; score is floor(2000000 a / (l + r)). A phrase
    goes if its words lie inside a longer one that has `share` percent of its occurrences. Ties go by a, then by the phrase's bytes. An empty table
    gives an empty result.
    """
    counts, totals = phrase_counts(docs, least, shard_words, lang, text)
    split = F.split("phrase", " ", -1)
    known = cut(counts.withColumn("words", split))
    candidates = known.where(F.size("words") > 1).withColumnRenamed("f", "a")
    size = F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("head"), _joined(F.col("words"), F.col("k") + 1, F.size("words")).alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = F.sequence(F.lit(2), size - 1)
    within = candidates.where(size > 2).select("lang", "words", "a", F.explode(inner).alias("m")).select("lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("s"))
    within = within.select("lang", _joined(F.col("words"), F.col("s"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    ten = F.lit(100).cast("decimal(3,0)")
    covered = ten * F.col("longer").cast("decimal(19,0)") >= F.lit(share).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")
    kept = scored.join(within, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("__p", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("__r", F.row_number().over(Window.partitionBy("lang", "__p").orderBy(*order)))
    best = parts.where(F.col("__r") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j AS k, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS tail
  FROM counts c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < c.k
), scored AS (
  SELECT x.lang, x.phrase, x.a, x.k, h.f AS l, t.f AS r, (2000000::HUGEINT * x.a) // (h.f + t.f) AS score
  FROM cuts x JOIN counts h ON h.lang = x.lang AND h.phrase = x.head JOIN counts t ON t.lang = x.lang AND t.phrase = x.tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT c.lang, array_to_string(string_split(c.phrase, ' ')[s:s + m - 1], ' ') AS phrase, max(c.f) AS longer
  FROM counts c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < c.k AND s + m - 1 <= c.k GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000"""
