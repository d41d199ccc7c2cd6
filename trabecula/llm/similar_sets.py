"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, without loss.

Shingles are put into one global order, common ones last. If two sets are that similar, their first n - ceil(0.8 n) + 1 shingles have one in
common: these are the keys. Pairs that share a key pass two tests that never lose a similar pair, sizes and parity sketches (a sketch differs in
at most as many bits as the sets differ in shingles; short ones beside the keys, wide ones for the pairs left), and are then compared on their whole sets. The first round compares pairs that span the
candidates of each key, the second all candidates that the links of the first have left in different components.

Ahead of both, SimHash fingerprints of the sets are linked by the pigeonring and the links compared on the whole sets; the keys then serve only what
fingerprints lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.llm.common import by_whole_groups, cut, held, in_block_pairs, shingle_hashes
from trabecula.llm.graph import fold_labels, star_components
from trabecula.llm.simhash import set_fingerprint, spanning_links

WORDS = 5
SKETCH_BITS = 512
#: Rows of one key that are compared in one piece of work; keys with more are cut into pairs of blocks.
BLOCK_ROWS = 1024
#: Rows that tell which shingles are common (that only sets their order), their least share of these rows, and how many are kept.
SAMPLE_ROWS, COMMON_SHARE, COMMON_KEPT = 4000, 0.005, 1 << 16


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles; a shorter text is one shingle, one without words has none."""
    parts = list(shingle_hashes(text, WORDS))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def key_count(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def sketch(own: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the number of shingles at each bit; `bits` is a power of two."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def wide_sketch(own: np.ndarray) -> np.ndarray:
    """A sketch with two to four bits for each shingle: sets that differ in a quarter of their shingles or more hardly ever pass its test."""
    return sketch(own, max(SKETCH_BITS, 1 << (2 * len(own) - 1).bit_length()))


def sketches_differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, at the width of the narrower one: halves of the wider one are folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def first_keys(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set's first shingles in the global order; `common` is sorted, `rank` its order from rare to frequent."""
    if not len(common):
        return own[:key_count(len(own))]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    late = np.where(common[at] == own, 1 + rank[at], 0)
    return own[np.argsort(late, kind="stable")[:key_count(len(own))]]


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    every = max(1, rows.count() // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("__text"), F.lit(every)) == 0).select("__text")

    def run(batches):
        for b in batches:
            for t in b.column("__text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["h"])

    least = max(3, int(COMMON_SHARE * SAMPLE_ROWS))
    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(COMMON_KEPT).collect()
    by_count = np.array([r["h"] for r in reversed(found)], np.int64).view(np.uint64)
    order = np.argsort(by_count)
    return by_count[order], order


def _profiles(rows: DataFrame) -> DataFrame:
    """doc_id, sha, k1 and k2 (128-bit name of the shingle set), n, fp, sketch, wide, keys."""
    common, rank = common_shingles(rows)

    def run(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            sets = [shingle_set(t) for t in b.column("__text").to_pylist()]
            names = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("sha"), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.array([set_fingerprint(s) for s in sets], np.uint64).view(np.int64)),
                 pa.array([sketch(s).tobytes() for s in sets], pa.binary()), pa.array([wide_sketch(s).tobytes() for s in sets], pa.binary()), pa.array([first_keys(s, common, rank).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "sha", "k1", "k2", "n", "fp", "sketch", "wide", "keys"])

    more = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "n", "fp")] + [F.lit(b"").alias("sketch"), F.lit(b"").alias("wide"), F.array().cast("array<long>").alias("keys")]
    return rows.mapInArrow(run, rows.select("doc_id", "sha", *more).schema)


def _shared_only(batches: Iterator) -> Iterator:
    """Rows (key, node) in order of the key without the keys of a single row."""
    key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before: int | None = None  # key of the row ahead of those held

    def out(key, node, last):
        same = np.r_[before is not None and len(key) and key[0] == before, key[1:] == key[:-1]].astype(bool)[:len(key)]
        keep = same | np.r_[same[1:], False][:len(key)]
        if not last:
            key, node, keep = key[:-1], node[:-1], keep[:-1]
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])

    for b in batches:
        key, node = np.r_[key, b.column("key").to_numpy()], np.r_[node, b.column("node").to_numpy()]
        if len(key) > 1:
            yield out(key, node, False)
            before, key, node = int(key[-2]), key[-1:], node[-1:]
    if len(key):
        yield out(key, node, True)


def candidates_of(rows: dict[str, np.ndarray], spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that may be similar and are not known to be joined; if `spanning`, only enough of them to join what can be."""
    group, n, root, side, words = rows["group"], rows["n"], rows["root"], rows["side"], rows["sketch"]
    new = np.r_[True, group[1:] != group[:-1]]
    end = np.append(np.flatnonzero(new)[1:], len(group))[np.cumsum(new) - 1]
    idx, label, d = np.arange(len(group)), np.arange(len(group)), 0
    while len(idx := idx[idx + (d := d + 1) < end[idx]]):
        a, b = idx, idx + d
        ok = (root[a] != root[b]) & ((side[a] < 0) | (side[a] != side[b])) & (4 * np.maximum(n[a], n[b]) <= 5 * np.minimum(n[a], n[b]))
        if spanning:
            ok &= label[a] != label[b]
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64) * 9 <= n[a] + n[b]
        a, b = a[ok], b[ok]
        if len(a):
            yield a, b
            if spanning:
                label = fold_labels(label, a, b)


def candidate_pairs(shared: DataFrame, facts: DataFrame, spanning: bool, block_rows: int) -> DataFrame:
    """Distinct (a, b), a < b, from rows (key, node) and facts (node, n, sketch, root). A key with many rows is dealt out as pairs of blocks."""
    large = cut(shared.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block_rows))
    rows = in_block_pairs(shared.join(large, "key", "left").join(facts, "node"), "rows", block_rows)
    group = ["key", "lo", "hi"]

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {x: t.column(x).to_numpy() for x in (*group, "block", "node", "n", "root")}
        change = np.r_[False, (c["key"][1:] != c["key"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])]
        c |= {"group": np.cumsum(change), "side": np.where(c["lo"] == c["hi"], -1, c["block"])}
        c["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
        for a, b in candidates_of(c, spanning):
            x, y = c["node"][a], c["node"][b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        yield from by_whole_groups(batches, group, pairs)

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long").distinct()


def fingerprint_pairs(profiles: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that join the rows (node, fp) of equal fingerprints and the fingerprints within three bits."""
    prints = cut(profiles.groupBy("fp").agg(F.min("node").alias("node")))
    same = profiles.select("fp", F.col("node").alias("b")).join(prints.withColumnRenamed("node", "a"), "fp").where("a < b").select("a", "b")
    return same.unionByName(spanning_links(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")).distinct()


def similar_groups(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: doc_id, sha (of the text) and keep, the smallest (no id, doc_id, sha) of the rows reachable over similar pairs.

    Null texts count as empty; texts without words are one group. A row is known by its id and text, so ids may repeat.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.sha2(whole.cast("binary"), 256).alias("sha"), whole.alias("__text"))
    base = cut(_profiles(rows).withColumn("row", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")).alias("least")
    nodes = cut(base.groupBy("k1", "k2").agg(least, F.min("row").alias("node")))
    again = cut(base.select("row").join(nodes.select(F.col("node").alias("row")), "row", "left_anti"))
    profiles = base.select(F.col("row").alias("node"), "n", "fp", "sketch", "keys").join(again.withColumnRenamed("row", "node"), "node", "left_anti")
    keys = profiles.select(F.explode("keys").alias("key"), "node")
    shared = cut(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_only, "key long, node long"))
    texts = rows if base.groupBy("doc_id", "sha").count().where("count > 1").isEmpty() else rows.dropDuplicates(["doc_id", "sha"])

    def ends(pairs):
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def similar(pairs):
        used = cut(ends(pairs))
        wide = cut(held(base.select(F.col("row").alias("node"), "n", "wide"), used, "node").join(used, "node"))
        pairs = _plausible(pairs, wide)
        used = cut(ends(pairs))
        where = cut(held(nodes, used, "node").join(used, "node").select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.sha").alias("sha")))
        return cut(_verified(pairs, where, held(texts, where, "doc_id", "sha"), block_rows))

    def facts(roots):
        return profiles.select("node", "n", "sketch").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    links = similar(cut(fingerprint_pairs(profiles)))
    tried = cut(candidate_pairs(shared, cut(facts(star_components(links))), True, block_rows))
    links = links.unionByName(similar(tried))
    roots = cut(star_components(links))
    # a row that has any candidate is in a pair of the first round of keys, so these rows serve the second as well
    used = cut(ends(tried))
    more = cut(candidate_pairs(shared.join(used, "node"), cut(facts(roots).join(used, "node")), False, block_rows).join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty() and not (late := similar(more)).isEmpty():
        roots = cut(star_components(links.unionByName(late)))
    placed = cut(nodes.join(roots, "node", "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root")))
    keep = cut(placed.groupBy("root").agg(F.min("least").alias("keep")))
    return base.select("doc_id", "sha", "k1", "k2").join(cut(placed.join(keep, "root").select("k1", "k2", "keep")), ["k1", "k2"]).select("doc_id", "sha", "keep")


def _plausible(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide sketches leave them similar. No similar pair is lost, and texts of the others need not travel."""
    both = pairs
    for side in "ab":
        both = both.join(wide.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"w{side}")), side)

    def run(batches):
        for b in batches:
            counts = zip(*[b.column(c).to_pylist() for c in ("na", "nb", "wa", "wb")])
            keep = pa.array([9 * sketches_differ(x, y) <= m + n for m, n, x, y in counts], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return cut(both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, where: DataFrame, texts: DataFrame, block_rows: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar. `where` has the id and text hash of each node, `texts` the texts.

    Texts travel, which are smaller than their sets, once for each pair they are the second of and once for each block of up to about `block_rows` pairs they
    are the first of. A block streams: only the set of its first text is kept.
    """
    blocks = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__blocks")))
    dealt = cut(pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("__blocks")).alias("block"), "b"))
    first = dealt.select("a", "block", F.lit(0).alias("part"), F.col("a").alias("node")).distinct()
    roles = cut(first.unionByName(dealt.select("a", "block", F.lit(1).alias("part"), F.col("b").alias("node"))).join(where, "node"))
    roles = roles.withColumnsRenamed({"doc_id": "__id", "sha": "__sha"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))
    order = ["a", "block", "part"]

    def run(batches):
        own = None
        for b in batches:
            out = []
            for a, part, node, text in zip(*[b.column(c).to_pylist() for c in ("a", "part", "node", "__text")]):
                held = shingle_set(text)
                if not part:
                    own = held
                elif 9 * len(np.intersect1d(own, held, assume_unique=True)) >= 4 * (len(own) + len(held)):
                    out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return texts.join(roles, same).select(*order, "node", "__text").repartition("a", "block").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")
