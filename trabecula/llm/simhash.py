"""SimHash near-duplicates with pigeonring candidate pruning.

A 64-bit fingerprint is cut into d + 1 segments on a ring. If two fingerprints differ in at most d bits, some segment starts a chain whose
first l segments together differ in at most floor(l * d / (d + 1)) bits, for every l. So the first segment is equal: it is the bucket. Inside a
bucket the rest of the chain is tested before the full check. A bucket with too many fingerprints is split by the same budgets: the next
segments may hold only c differing bits, so of c + 1 parts of one of them at least one is equal and becomes part of the key. Every link is
found whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import DOCUMENT_COLUMNS, by_whole_groups, cut, in_block_pairs, shingle_hashes, table, without_texts
from trabecula.llm.graph import fold_labels, star_components

BITS = 64
#: Fingerprints compared pairwise in one bucket; larger buckets are split, at most so many times: fingerprints that still share a bucket then are
#: nearly equal, and splitting would only repeat them. Pairs of blocks of so many rows are compared then, which is as exact.
BUCKET_ROWS, MAX_SPLITS = 8192, 5
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_BYTE_OFFSET = np.arange(8, dtype=np.int64)[None, :] * 256


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def _count_bits(hashes: np.ndarray) -> np.ndarray:
    per_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSET).ravel(), minlength=2048).reshape(8, 256)
    return np.einsum("ij,jk->ik", per_byte, _BIT_OF_BYTE).ravel()


def fingerprint(text: str, words: int) -> np.ndarray:
    """64-bit fingerprint of a whole text, as one value: a bit is 1 if set in over half the XXH64 hashes of its shingles, repeats included. No words: zero."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        ones += _count_bits(hashes)
    return _majority(ones, n)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The same over distinct hashes, as an unsigned number."""
    return int(_majority(_count_bits(hashes), len(hashes))[0])


def fingerprints(docs: DataFrame, keys: list[str], words: int = 3, text: str = "text") -> DataFrame:
    """`keys` and `fp`, the fingerprint as a signed long. Null texts count as empty: fingerprint zero."""
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = rows.drop("__text").select("*", F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words)[0] for t in b.column("__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(fp.view(np.int64))], names=[*keys, "fp"])

    return rows.mapInArrow(run, schema)


class Ring:
    """Segments, chain budgets and key masks for a distance."""

    def __init__(self, distance: int):
        self.distance, self.segments = distance, distance + 1
        edges = [round(i * BITS / self.segments) for i in range(self.segments + 1)]
        self.masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    def chains(self) -> np.ndarray:
        """[start, length - 1]: bits of the chain of that length."""
        return np.array([[sum(self.masks[(s + k) % self.segments] for k in range(n + 1)) for n in range(self.segments)] for s in range(self.segments)], np.uint64)

    def split(self, start: int, mask: int) -> list[int]:
        """Finer masks of which every pair in the bucket shares at least one value; none if the bucket can hold few fingerprints only."""
        best: tuple[float, list[list[int]]] = (0.0, [])
        for k in range(1, self.segments):
            own = self.masks[(start + k) % self.segments] & ~mask
            bits = [b for b in range(BITS) if own >> b & 1]
            parts = self.budget(k + 1) + 1
            if len(bits) >= parts and (gain := len(bits) / parts / math.log2(max(parts, 1.5))) > best[0]:
                best = (gain, [list(map(int, x)) for x in np.array_split(bits, parts)])
        return [mask | sum(1 << b for b in part) for part in best[1]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(rows: dict[str, np.ndarray], ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole buckets (rows of one `group`): chains first, then the full distance. Only a label per row is kept, and pairs that are
    joined already are skipped. `side`: rows of one side are compared with those of the other only; below zero: with all."""
    start, fp, node, group, side = rows["start"], rows["fp"], rows["node"], rows["group"], rows["side"]
    new = np.r_[True, group[1:] != group[:-1]]
    end = np.append(np.flatnonzero(new)[1:], len(fp))[np.cumsum(new) - 1]
    chains, idx, label, d = ring.chains(), np.arange(len(fp)), np.arange(len(fp)), 0
    while len(idx := idx[idx + (d := d + 1) < end[idx]]):
        a = idx[(label[idx] != label[idx + d]) & ((side[idx] < 0) | (side[idx] != side[idx + d]))]
        x = fp[a] ^ fp[a + d]
        for n in range(1, ring.segments):
            ok = np.bitwise_count(x & chains[start[a], n]) <= ring.budget(n + 1)
            a, x = a[ok], x[ok]
            if not len(a):
                break
        if len(a):
            label = fold_labels(label, a, a + d)
    i = np.flatnonzero(label != np.arange(len(fp)))
    return node[i], node[label[i]]


def spanning_links(nodes: DataFrame, distance: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between the rows `node`, `fp` that join everything within `distance` bits, without the other pairs of a group."""
    ring, spark = Ring(distance), nodes.sparkSession
    firsts = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in enumerate(ring.masks)])
    own = ["node", "fp"]
    rows = nodes.select(*own, F.explode(firsts).alias("k")).select(F.col("k.start").alias("start"), F.col("k.mask").alias("mask"), *own)
    known, links = {(s, m) for s, m in enumerate(ring.masks)}, []
    key = ["start", "mask", "value"]
    group = [*key, "lo", "hi"]

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {x: t.column(x).to_numpy() for x in (*group, "block", *own)}
        change = np.logical_or.reduce([c[x][1:] != c[x][:-1] for x in group])
        side = np.where(c["lo"] == c["hi"], -1, c["block"])
        a, b = _bucket_links(c | {"fp": c["fp"].view(np.uint64), "group": np.cumsum(np.r_[False, change]), "side": side}, ring)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        yield from by_whole_groups(batches, group, found)

    splits = 0
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        finer = {km: parts for km in known if (parts := ring.split(*km))}
        large = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows))
        last = not finer or splits == MAX_SPLITS or large.isEmpty()
        splits += 1
        if not last:
            # a few rows per level, made from the ring and not from the data
            masks = spark.createDataFrame([(s, _signed(m), [_signed(x) for x in parts]) for (s, m), parts in finer.items()], "start int, mask long, finer array<long>")
            hot = cut(large.join(masks, ["start", "mask"], "left_semi"))
        # what no split parts is compared all the same, in pairs of blocks that tasks share
        small = in_block_pairs(rows.join(large, key, "left"), "n", bucket_rows) if last else in_block_pairs(rows.join(hot, key, "left_anti").withColumn("n", F.lit(1)), "n", bucket_rows)
        links.append(cut(small.select(*group, "block", *own).repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")))
        if last:
            break
        rows = cut(rows.join(hot, key, "left_semi").join(masks, ["start", "mask"]).select("start", F.explode("finer").alias("mask"), *own))
        known = {(s, x) for (s, _), parts in finer.items() for x in parts}
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3, bucket_rows: int = BUCKET_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable over links of at most `distance` bits).

    Equal fingerprints are joined once, as one. Texts without words have fingerprint zero and are linked like any other; null ids are kept and never
    name a component that has another. An empty table gives an empty result; other columns are not read.
    """
    base = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], words))
    nodes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    roots = star_components(spanning_links(nodes, distance, bucket_rows))
    placed = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    names = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    of_print = cut(placed.join(names, "root").select("fp", "component_id"))
    return base.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest doc_id of each near-duplicate component stays, and rows without an id.

    Links: a Jaccard similarity of 0.8 or more of the sets of five-word shingles, all of them and no others. SimHash fingerprints linked by the
    pigeonring come first, every link is checked on the whole sets, and exact keys serve what fingerprints lose.
    """
    from trabecula.llm.similar_sets import similar_groups  # it links fingerprints by this module

    docs = docs.select(*DOCUMENT_COLUMNS)
    found = similar_groups(docs).where("doc_id is not null")
    gone = cut(found.where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("sha") != F.col("keep.sha"))).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct())
    return without_texts(docs, gone)
