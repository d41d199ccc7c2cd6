"""Removal of long repeated byte strings by bucket-pointer refinement over content-chosen suffixes.

Every start of a long string (default 400 bytes) is owned by an anchor: the rightmost least 8-byte gram among the 256 grams from that start. Equal
strings have their anchor at the same offset, so only suffixes at anchors are put into buckets, each for all of its starts at once:

- the initial bucket of an anchor is the q-gram that all strings of its starts share (145 bytes from the anchor on);
- a bucket of one row holds no repeat and is finished; rows of a bucket whose whole surroundings are equal are repeats at every start and finished too;
- the other rows are refined: their starts are dealt into four ranges, and the bucket of a range is the identifier of the old bucket sorted on the
  identifiers of the grams at the offsets before and behind it that the strings of the range also share. Identifiers of one round are the first
  half of those of the next, so no gram is named twice. After four rounds a range is one start and its bucket is the whole string.

Identifiers are 128-bit hashes of bucket and grams. Each round meets as an aggregate over identifiers, combined before the shuffle, so a passage
that a third of all rows share costs no more than its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import cut, table

LENGTH = 400
#: Starts that may share an anchor, the bytes of an anchor's gram, and the ranges that a refined bucket is dealt into.
SPREAD, GRAM, FAN = 256, 8, 4
#: Starts whose anchors are chosen at once; bounds the arrays of a very long text.
STARTS_AT_ONCE = 1 << 20
#: Rows that a task hands on at once.
ROWS_AT_ONCE = 1 << 16

KEY, NAMES = ["doc_id", "t1", "t2"], ["b1", "b2", "f1", "f2"]
_LONGS = pa.int64()


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` values from each place on, by running minima of blocks of that width."""
    n = len(values) - width + 1
    whole = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[:len(values)] = values
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], back[width - 1:width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) for the runs of starts of one text; no starts if the text is shorter than `length`."""
    starts = len(data) - length + 1
    own, first = [], []
    for at in range(0, max(starts, 0), STARTS_AT_ONCE):
        n = min(STARTS_AT_ONCE, starts - at)
        grams = n + spread - 1
        mixed = np.empty(grams, np.uint64)
        for k in range(min(GRAM, grams)):  # every eighth gram is a number as it lies
            mixed[k::GRAM] = np.frombuffer(data, "<u8", (grams - k + GRAM - 1) // GRAM, at + k)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed &= np.uint64(0xFFFFFFFF00000000)
        mixed |= np.arange(grams, dtype=np.uint64)[::-1]  # of equal grams the rightmost is least
        chosen = at + grams - 1 - (_least_ahead(mixed, spread) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        if own and own[-1][-1] == chosen[0]:
            new = new[1:]
        own.append(chosen[new])
        first.append(new + at)
        if not len(new):
            own.pop(), first.pop()
    if not own:
        return (np.zeros(0, np.int64),) * 3
    own, first = np.concatenate(own), np.concatenate(first)
    return own, first, np.append(first[1:], starts) - 1


def _name(*parts: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b"".join(parts))


def _around(data: bytes, first: int, last: int, length: int) -> bytes:
    """Name of all bytes of the strings with starts first to last, and of what a text's ends cut off, if anything."""
    left, right = max(0, -first), max(0, last + length - len(data))
    cut_off = (left.to_bytes(4, "little"), right.to_bytes(4, "little")) if left or right else ()
    return _name(data[max(0, first):last + length], *cut_off)


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the intervals [first, end)."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.r_[True, first[1:] > end[:-1]]
    return first[new], end[np.append(np.flatnonzero(new)[1:], len(first)) - 1]



def _longs(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)


def _first_names(batches: Iterator, length: int, spread: int) -> Iterator[pa.RecordBatch]:
    """One row per text and surroundings of an anchor: the text's number, the anchor, its starts, bucket and surroundings names, number of places, and
    the spans that repeat inside the text. The first row of a text also has its id and name."""
    from pyspark import TaskContext
    from xxhash import xxh3_128_digest as digest

    doc, core = TaskContext.get().partitionId() << 40, length - spread + 1
    kind = pa.list_(pa.struct([("first", _LONGS), ("end", _LONGS)]))
    for b in batches:
        texts, whose, sizes, ids, names, plain, spans = [], [], [], [], [], [], []

        def made():
            starts = np.cumsum([0, *sizes[:-1]])
            key_at, t1, t2 = np.full(sum(sizes), -1, np.int64), *(np.zeros(sum(sizes), np.int64) for _ in range(2))
            key_at[starts] = whose
            t1[starts], t2[starts] = _longs(texts).T
            none = pa.array(key_at < 0)
            take = pa.array(np.where(key_at < 0, 0, key_at), mask=key_at < 0)
            own, four = np.array(plain, np.int64).reshape(-1, 4), np.frombuffer(b"".join(names), np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids, np.int64), sizes)), b.column("doc_id").take(take), *[pc.if_else(none, None, pa.array(t)) for t in (t1, t2)],
                 *[pa.array(own[:, k].astype(np.int32)) for k in range(3)], pa.array(own[:, 3].copy()), pa.array(spans, kind), *[pa.array(four[:, k].copy()) for k in range(4)]],
                names=["doc", *KEY, "at", "first", "last", "places", "own", *NAMES])

        for i, data in enumerate(b.column("data").to_pylist()):
            at, first, last = anchors(data, length, spread)
            if not len(at):
                continue
            size = len(data) - length
            at, first, last = at.tolist(), first.tolist(), last.tolist()
            buckets = [digest(data[a:a + core]) for a in at]
            arounds = [digest(data[a - spread + 1:a + length]) if spread <= a + 1 and a <= size else _around(data, a - spread + 1, a, length) for a in at]
            keys = list(map(bytes.__add__, buckets, arounds))
            doc += 1
            texts.append(digest(data))
            ids.append(doc)
            whose.append(i)
            sizes.append(len(set(keys)))
            if sizes[-1] == len(keys):
                names += keys
                plain += zip(at, first, last, [1] * len(at))
                spans += [None] * len(at)
            else:
                places: dict[bytes, list[int]] = {}
                for k, key in enumerate(keys):
                    places.setdefault(key, []).append(k)
                for key, own in places.items():
                    names.append(key)
                    plain.append((at[own[0]], first[own[0]], last[own[0]], len(own)))
                    if len(own) == 1:
                        spans.append(None)
                        continue
                    s, e = merged(np.array([first[k] for k in own]), np.array([last[k] + length for k in own]))
                    spans.append([{"first": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
            if len(names) >= ROWS_AT_ONCE:
                yield made()
                texts, whose, sizes, ids, names, plain, spans = [], [], [], [], [], [], []
        if names:
            yield made()


def _dealt(context: bytes, base: int, size: int, start: int, width: int, own: tuple[int, int], bucket: bytes, length: int) -> Iterator[tuple]:
    """The ranges of starts [start, start + width) of one row of a bucket, if they hold starts of the row and lie in the text (of `size` bytes).

    `context` holds the text's bytes from `base` on. Yields start, bucket name, surroundings name.
    """
    part = width // FAN
    for lo in range(start, start + width, part):
        hi = lo + part - 1
        if hi < own[0] or lo > own[1] or hi < 0 or lo + length > size:
            continue
        # the strings of all starts share the bytes from hi to lo + length; of them the old bucket names those from the last old start on
        old_from, old_to = start + width - 1, start + length
        before, behind = context[hi - base:old_from - base], context[old_to - base:lo + length - base]
        left, right = max(0, -lo), max(0, hi + length - size)
        cut_off = (left.to_bytes(4, "little"), right.to_bytes(4, "little")) if left or right else ()
        around = _name(context[max(0, lo) - base:hi + length - base], *cut_off)
        yield lo, _name(bucket, before, behind, (lo - start).to_bytes(4, "little")), around


_REFINED = "doc long, own_first int, own_last int, size int, start int, width int, places long, b1 long, b2 long, f1 long, f2 long, base int, context binary"


def _refined_columns(rows: list[tuple]) -> pa.RecordBatch:
    *plain, names, base, context = zip(*rows)
    names = np.frombuffer(b"".join(names), np.int64).reshape(-1, 4)
    kinds = [_LONGS, *[pa.int32()] * 5, _LONGS]
    return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(plain, kinds)], *[pa.array(names[:, k].copy()) for k in range(4)], pa.array(base, pa.int32()), pa.array(context, pa.binary())],
                                      names=["doc", "own_first", "own_last", "size", "start", "width", "places", "b1", "b2", "f1", "f2", "base", "context"])


def _refine(batches: Iterator, length: int) -> Iterator[pa.RecordBatch]:
    """Rows to be refined (with context) as rows of the next round."""
    for b in batches:
        out = []
        names = np.stack([b.column(c).to_numpy() for c in ("b1", "b2")], 1)
        columns = [b.column(c).to_pylist() for c in ("doc", "own_first", "own_last", "size", "start", "width", "n", "base", "context")]
        for bucket, doc, lo_own, hi_own, size, start, width, n, at, context in zip(names, *columns):
            part = width // FAN
            for lo, name, around in _dealt(context, at, size, start, width, (lo_own, hi_own), bucket.tobytes(), length):
                base = max(0, lo)
                out.append((doc, lo_own, hi_own, size, lo, part, n, name + around, base, context[base - at:lo + part - 1 + length - at] if part > 1 else b""))
        if out:
            yield _refined_columns(out)


def _which(at: str) -> Column:
    return F.xxhash64("doc", at)


def _met(rows: DataFrame, at: str) -> DataFrame:
    """Buckets with more than one place: n places with the same surroundings, one of them (`which`), and whether the bucket has others (`open`)."""
    each = cut(rows.groupBy(*NAMES).agg(F.sum("places").alias("n"), F.min(_which(at)).alias("which")))
    many = each.groupBy("b1", "b2").agg(F.sum("n").alias("total")).where("total > 1")
    return cut(each.join(cut(many), ["b1", "b2"]).select(*NAMES, "n", "which", (F.col("total") > F.col("n")).alias("open")))


def _still_open(rows: DataFrame, met: DataFrame, at: str) -> DataFrame:
    """The rows to be refined, with n: those that are alone with their surroundings, and one for all that share theirs."""
    return rows.join(met.where("open"), NAMES).where(_which(at) == F.col("which")).drop("which", "open")


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """doc_id, t1, t2 (128-bit name of the text) and spans: the maximal runs of bytes covered by strings of `length` bytes that start more than once.

    One row per distinct (doc_id, text) that has any. `spread` is a power of four of at most length - 8. Null texts count as empty, texts shorter than
    `length` have no span; rows that repeat with id and text repeat each other. Overlaps within one text count. Very long texts are read whole.
    An empty table gives an empty result; other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).where(F.length("data") >= length)
    id_type = source.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {id_type}, t1 long, t2 long"
    first = cut(source.mapInArrow(lambda batches: _first_names(batches, length, spread),
                                  f"doc long, {key}, at int, first int, last int, places long, own array<struct<first:long,end:long>>, b1 long, b2 long, f1 long, f2 long"))
    texts = first.where("t1 is not null").select("doc", *KEY)
    # most buckets hold one place: half an identifier tells them, and the wide rows of the others travel
    shared = first.groupBy("b1").agg(F.sum("places").alias("n")).where("n > 1").select("b1")
    first = cut(first.drop(*KEY).join(shared, "b1", "left_semi"))
    met = _met(first, "at")
    one = F.struct(F.col("first").cast("long").alias("first"), (F.col("last") + length).cast("long").alias("end"))
    found = [cut(first.join(met.where("n > 1").select(*NAMES), NAMES).select("doc", F.explode(F.coalesce("own", F.array(one))).alias("s")).select("doc", "s.first", "s.end"))]

    # texts of the rows to be refined are read once more; then the rows travel with the bytes around their starts
    rows = _still_open(first.select("doc", "at", "first", "last", *NAMES), met, "at").select("doc", F.struct("doc", "at", "first", "last", "b1", "b2", "n").alias("row"))
    per_text = cut(rows.join(texts, "doc").groupBy(*KEY).agg(F.collect_list("row").alias("rows")))
    side = per_text.select(*[F.col(k).alias(f"__{k}") for k in KEY], "rows")
    named = source.mapInArrow(_named, f"{key}, data binary")
    rows = cut(named.join(side, _same_text()).select("data", "rows").mapInArrow(lambda batches: _opened(batches, length, spread), _REFINED))
    width = spread // FAN
    while True:
        met = _met(rows, "start")
        inside = rows.join(met.where("n > 1").select(*NAMES), NAMES).select(
            "doc", F.greatest("start", F.lit(0)).cast("long").alias("first"), (F.least(F.col("start") + F.col("width") - 1, F.col("size") - length) + length).cast("long").alias("end"))
        found.append(cut(inside.distinct()))
        if width == 1:
            break
        rows = cut(_still_open(rows.drop("places"), met, "start").mapInArrow(lambda batches: _refine(batches, length), _REFINED))
        width //= FAN
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    merged_lists = cut(lists.mapInArrow(_merge_lists, "doc long, spans array<struct<first:long,end:long>>"))
    return cut(merged_lists.join(texts, "doc").drop("doc").dropDuplicates(KEY))


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("t1") == F.col("__t1")) & (F.col("t2") == F.col("__t2"))


def _named(batches: Iterator) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = _longs([_name(x) for x in b.column("data").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), b.column("data")], names=[*KEY, "data"])


def _opened(batches: Iterator, length: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Rows of the first refinement from whole texts and their rows."""
    part = spread // FAN
    for b in batches:
        for r in b.to_pylist():
            data, out = r["data"], []
            for x in r["rows"]:
                start, bucket = x["at"] - spread + 1, np.array([x["b1"], x["b2"]], np.int64).tobytes()
                for lo, name, around in _dealt(data, 0, len(data), start, spread, (x["first"], x["last"]), bucket, length):
                    base = max(0, lo)
                    out.append((x["doc"], x["first"], x["last"], len(data), lo, part, x["n"], name + around, base, data[base:lo + part - 1 + length] if part > 1 else b""))
            if out:
                yield _refined_columns(out)


def _merge_lists(batches: Iterator) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", _LONGS), ("end", _LONGS)]))
    for b in batches:
        spans = []
        for own in b.column("spans").to_pylist():
            s, e = merged(np.array([x["first"] for x in own]), np.array([x["end"] for x in own]))
            spans.append([{"first": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(spans, kind)], names=["doc", "spans"])


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (the removed runs), kept_sha256, and with `keep_bytes` kept, the bytes that remain.

    Bytes are judged on the input, so a removal never makes another string a repeat; what remains may cut a code point and is binary.
    """
    spans = repeated_spans(docs, length, doc_id, text)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    named = source.mapInArrow(_named, f"doc_id {id_type}, t1 long, t2 long, data binary")
    side = spans.select(*[F.col(k).alias(f"__{k}") for k in KEY], "spans")

    def run(batches):
        kind = pa.list_(pa.struct([("first", _LONGS), ("end", _LONGS)]))
        for b in batches:
            digests, kept, sizes = [], [], []
            for data, own in zip(b.column("data").to_pylist(), b.column("spans").to_pylist()):
                at, pieces = 0, []
                for s in own or ():
                    pieces.append(data[at:s["first"]])
                    at = s["end"]
                left = b"".join([*pieces, data[at:]])
                digests.append(hashlib.sha256(left).hexdigest())
                sizes.append(len(data))
                kept.append(left if keep_bytes else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, _LONGS), b.column("spans").cast(kind), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept_sha256", "kept"])

    out = named.join(side, _same_text(), "left").select("doc_id", "data", "spans").mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, spans array<struct<first:long,end:long>>, kept_sha256 string, kept binary")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:long,end:long>>")))
    return out if keep_bytes else out.drop("kept")


def op12_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
