"""Benchmark decontamination by the q-gram lemma: count shared q-grams in diagonal bands, verify dense bands by banded alignment.

A benchmark item is cut into windows. If a window of m characters occurs in a text with at most k edits, the two share at least
m + 1 - q - k q q-grams, all on at most k + 1 neighbouring diagonals (text position minus window position). Diagonals are grouped into
bands that overlap by k, so one band holds them all. Bands that reach the count go to an alignment limited to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import DOCUMENT_COLUMNS, table

Q = 12
WINDOW, STEP = 160, 80
ERROR_RATE = 0.05
BAND = 16
#: Benchmark characters per pass over the documents; larger benchmarks are worked off in such blocks.
BLOCK_CHARS = 2_000_000
#: Characters handled at once in a task. Longer texts are read in parts that overlap by more than any window and its band.
PART_CHARS, OVERLAP = 1 << 20, 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BITMAP_BITS = 20


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with runs of white space as one space, none at the ends, and each one's position in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer lower forms: those stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (codes <= 32) | (codes == 0xA0)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    out = np.where(blank[at], np.uint32(32), codes[at])
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q code points from each position on (Q = 12: doubled to 8, then 4 more)."""
    h1 = codes.astype(np.uint64)
    h2 = h1[:-1] * np.uint64(_BASE) + h1[1:]
    h4 = h2[:-2] * np.uint64(_BASE**2 % 2**64) + h2[2:]
    h8 = h4[:-4] * np.uint64(_BASE**4 % 2**64) + h4[4:]
    return (h8[:-4] * np.uint64(_BASE**4 % 2**64) + h4[8:]) * _MIX


@dataclass
class Index:
    """Windows of one benchmark block and their q-grams."""

    item: list[int]  # item of each window
    total: dict[int, int]  # windows of each item
    codes: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray  # q-grams a match shares at least
    grams: np.ndarray  # sorted hashes
    of: np.ndarray  # window of each
    at: np.ndarray  # position of each in its window
    bitmap: np.ndarray
    tiny: list[tuple[int, str]]  # items below Q characters: only equal substrings count


def build_index(items: list[tuple[int, str | None]], error_rate: float) -> Index:
    item, total, codes, edits, least, grams, of, at, tiny = [], {}, [], [], [], [], [], [], []
    for key, text in items:
        own, _ = normalise(text or "")
        if len(own) < Q:
            if len(own):
                tiny.append((key, own.tobytes().decode("utf-32-le", "surrogatepass")))
                total[key] = total.get(key, 0) + 1
            continue
        starts = [0] if len(own) <= WINDOW else sorted({*range(0, len(own) - WINDOW + 1, STEP), len(own) - WINDOW})
        total[key] = total.get(key, 0) + len(starts)
        for s in starts:
            w = own[s:s + WINDOW]
            k = min(int(error_rate * len(w)), (len(w) - Q) // Q)
            h = gram_hashes(w)
            grams.append(h), of.append(np.full(len(h), len(item))), at.append(np.arange(len(h)))
            item.append(key), codes.append(w), edits.append(k), least.append(len(w) + 1 - Q - k * Q)
    g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    bitmap = np.zeros(1 << _BITMAP_BITS, bool)
    bitmap[(g >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)] = True
    cat = lambda x: np.concatenate(x)[order] if x else np.zeros(0, np.int64)
    return Index(item, total, codes, np.array(edits, np.int64), np.array(least, np.int64), g[order], cat(of), cat(at), bitmap, tiny)


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Least edits of the pattern against any stretch of the text on the diagonals low .. low + width - 1, and the stretch's end."""
    far = len(pattern) + width + 1
    c = np.arange(width)
    row = np.where((low + c >= 0) & (low + c <= len(text)), 0, far)
    for i, p in enumerate(pattern):
        j = low + c + i  # text position met by this pattern position on each diagonal
        inside = (j >= 0) & (j < len(text))
        miss = np.where(inside, text[np.clip(j, 0, max(len(text) - 1, 0))] != p, True)
        step = np.minimum(np.where(inside, row + miss, far), np.append(row[1:], far) + 1)
        row = np.minimum.accumulate(step - c) + c  # further text characters inside the stretch
        row = np.where((j + 1 >= 0) & (j + 1 <= len(text)), row, far)
    best = int(np.argmin(row))
    return int(row[best]), low + best + len(pattern)


def matches(codes: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(window, distance, start, end) of each matching band in codes that may hold several texts, apart by zeros."""
    if len(codes) < Q or not len(index.grams):
        return
    h = gram_hashes(codes)
    pos = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)])
    lo = np.searchsorted(index.grams, h[pos], "left")
    n = np.searchsorted(index.grams, h[pos], "right") - lo
    pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
    if not len(pos):
        return
    each = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    window, diagonal = index.of[each], np.repeat(pos, n) - index.at[each]
    band, rest = np.divmod(diagonal, BAND)
    span = len(codes) // BAND + 2 * WINDOW
    again = rest < index.edits[window]
    key = np.concatenate([window * span + band + WINDOW, window[again] * span + band[again] - 1 + WINDOW])
    keys, count = np.unique(key, return_counts=True)
    window, band = np.divmod(keys, span)
    dense = count >= index.least[window]
    done: dict[int, int] = {}
    for w, b in zip(window[dense].tolist(), (band[dense] - WINDOW).tolist()):
        k, own = int(index.edits[w]), index.codes[w]
        left = b * BAND - k
        if done.get(w, -1) >= b * BAND:  # the match before lies in this band too
            continue
        start = max(0, left)
        distance, end = banded_distance(own, codes[start:b * BAND + BAND + 3 * k + len(own)], left - start, BAND + 3 * k)
        if distance <= k:
            end += start
            done[w] = end - len(own)
            yield w, distance, max(0, end - len(own)), end


def text_matches(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, window, distance, start, end) for all texts; positions count code points of the whole text."""
    group: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def flush():
        gap = np.zeros(Q, np.uint32)
        begins = np.cumsum([0, *[len(c) + Q for _, _, c, _ in group]])
        codes = np.concatenate([x for _, _, c, _ in group for x in (c, gap)])
        for w, distance, start, end in matches(codes, index):
            g = int(np.searchsorted(begins, end - 1, "right")) - 1
            row, shift, own, at = group[g]
            a, b = max(0, start - int(begins[g])), min(len(own), end - int(begins[g])) - 1
            yield row, index.item[w], w, distance, shift + int(at[a]), shift + int(at[b]) + 1
        for row, shift, own, at in group if index.tiny else []:
            flat = own.tobytes().decode("utf-32-le", "surrogatepass")
            for key, text in index.tiny:
                if (found := flat.find(text)) >= 0:
                    yield row, key, -1, 0, shift + int(at[found]), shift + int(at[found + len(text) - 1]) + 1

    size = 0
    for row, text in enumerate(texts):
        for shift in range(0, max(1, len(text) - OVERLAP), PART_CHARS):
            codes, at = normalise(text[shift:shift + PART_CHARS + OVERLAP])
            if len(codes):
                group.append((row, shift, codes, at))
                size += len(codes)
            if size >= PART_CHARS:
                yield from flush()
                group, size = [], 0
    if group:
        yield from flush()


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in blocks of bounded size, in order of the item ids; rows stream to the driver."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") + 1
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, keys: list[str], error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per document row and benchmark item found: `keys`, item_id, windows_found, windows, distance, start, end.

    An item of up to 160 normalised characters counts if the whole of it occurs within the edit budget, of a longer one windows of 160 at every
    80th character (and the last) are searched, so that any excerpt of 239 characters or more counts and shorter ones may not.
    `distance`, `start`, `end` are those of the closest window, first in the text. Case and white space don't count. Null and empty texts and items
    match nothing; items of under 12 characters match as equal substrings; repeated items and rows are reported each under their id.
    """
    rows = docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    out_types = {"item_id": pa.int64(), "windows_found": pa.int32(), "windows": pa.int32(), "distance": pa.int32(), "start": pa.int64(), "end": pa.int64()}
    schema = rows.drop("__text").select("*", *[F.lit(0).cast("long" if t == pa.int64() else "int").alias(c) for c, t in out_types.items()]).schema
    result = None
    for block in benchmark_blocks(benchmark):
        index = build_index(block, error_rate)

        def run(batches, index=index):
            for b in batches:
                best: dict[tuple[int, int], list] = {}
                for row, item, w, distance, start, end in text_matches(b.column("__text").to_pylist(), index):
                    own = best.setdefault((row, item), [set(), (distance, start, end)])
                    own[0].add(w)
                    own[1] = min(own[1], (distance, start, end))
                take = pa.array([row for row, _ in best], pa.int64())
                cols = list(zip(*[(item, len(ws), index.total[item], *place) for (_, item), (ws, place) in best.items()])) or [()] * 6
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in keys], *[pa.array(c, t) for c, t in zip(cols, out_types.values())]], names=[*keys, *out_types])

        found = rows.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """`docs` without the rows that hold a benchmark passage. Rows stay where they are: nothing is shuffled."""
    for block in benchmark_blocks(benchmark):
        index = build_index(block, error_rate)

        def run(batches, index=index):
            for b in batches:
                hit = {x[0] for x in text_matches([t or "" for t in b.column("text").to_pylist()], index)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a benchmark passage go."""
    return drop_contaminated(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))
