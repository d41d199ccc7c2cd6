"""Prefix trie of conversations with subtree totals by depth bands.

A node is a distinct sequence of first turns; its key adds up hashes of (place, turn), so a parent's key is the child's less its last turn and no
conversation is gathered whole. Subtree totals go by bands of a fixed number of depths: in a band each node adds its own values to its ancestors
of the same band only. The band roots form a smaller trie of their own, rolled up in the same way; a completed root then adds its total to its
ancestors in the band above. So no node explodes to more than one band, and the number of rounds grows with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import cut, table
from trabecula.operators.ordered import running_total

BAND = 8
#: conv_ids share the first turns of the conversation with the next lower multiple of this, at most HEADS - 1 of them.
FAMILY, HEADS = 20, 4
_WIDE = "decimal(38,0)"


def _hash(seed: int, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _wrapped(total: Column) -> Column:
    """A wide sum modulo 2^64, as a signed long."""
    half, whole = (F.lit(str(1 << bits)).cast("decimal(20,0)") for bits in (63, 64))
    low = F.pmod(total, whole)
    return F.when(low >= half, low - whole).otherwise(low).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), words, t1, t2 (128-bit name of role and text). Order: turn, nulls first; rows of one turn by role and name."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), words.alias("words"), _hash(1, role, F.length(role), text).alias("t1"), _hash(2, role, F.length(role), text).alias("t2"))
    rows = cut(rows.withColumn("turn", F.col("turn").cast("long")))
    order = [F.asc_nulls_first("turn"), "role", "t1", "t2"]
    # without a bucket the rows are cut by ranges, so one conversation may hold any share of them
    return running_total(rows, ["conv_id"], order, None, out="pos").select("conv_id", (F.col("pos") - 1).cast("long").alias("pos"), "words", "t1", "t2")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, words, t1, t2) of the rebuilt conversations, and (conv_id, size) with those that have no turn."""
    rows = rows.withColumn("heads", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("long"))
    ids = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.first("heads").alias("heads")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    sizes = cut(ids)
    given = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    sizes = cut(sizes.join(given, "base", "left").withColumn("taken", F.least("heads", F.coalesce("of_base", F.lit(0)))))
    first = rows.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "words", "t1", "t2")
    heads = first.join(sizes.select("conv_id", "base", "taken"), "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "words", "t1", "t2")
    # rows of a conversation know heads; what its base gives is one number for it
    own = rows.where("pos >= heads").join(sizes.select("conv_id", "taken"), "conv_id").select("conv_id", (F.col("pos") - F.col("heads") + F.col("taken") + 1).alias("depth"), "words", "t1", "t2")
    size = F.col("taken") + F.greatest(F.col("own") - F.col("heads"), F.lit(0))
    return cut(heads.unionByName(own)), sizes.select("conv_id", size.alias("size"))


def keyed(steps: DataFrame) -> DataFrame:
    """`steps` with k1, k2, the key of the node that the turn leads to, and p1, p2 of its parent (zero for the root)."""
    steps = steps.withColumn("s1", _hash(3, "depth", "t1", "t2")).withColumn("s2", _hash(4, "depth", "t2", "t1"))
    for k in "12":
        steps = running_total(steps, ["conv_id"], ["depth"], F.floor(F.col("depth") / 4096), F.col(f"s{k}").cast(_WIDE), f"r{k}")
    parent = [_wrapped(F.col(f"r{k}") - F.col(f"s{k}").cast(_WIDE)).alias(f"p{k}") for k in "12"]
    return cut(steps.select("conv_id", "depth", "words", *[_wrapped(F.col(f"r{k}")).alias(f"k{k}") for k in "12"], *parent))


def _in_band(path: DataFrame, values: list[str], band: int) -> DataFrame:
    """Totals per (node, depth) over the node's subtree inside its band.

    `path` has conv_id, depth, node and the values of the node the row stands for (null where another conversation stands for it).
    """
    rows = F.struct("depth", "node", *values)
    lists = path.groupBy("conv_id", F.floor(F.col("depth") / band).alias("band")).agg(F.array_sort(F.collect_list(rows)).alias("rows"))
    # a conversation's band is summed from its deep end first: one row per ancestor
    def below(name: str) -> Column:
        return F.aggregate(F.slice("rows", F.col("i") + 1, band), F.lit(0).cast("long"), lambda acc, r: acc + F.coalesce(r[name], F.lit(0)))

    each = lists.select("rows", F.posexplode("rows").alias("i", "at")).select("at.node", "at.depth", *[below(v).alias(v) for v in values])
    return each.groupBy("node", "depth").agg(*[F.sum(v).cast("long").alias(v) for v in values])


def rolled_up(path: DataFrame, values: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """(node, depth, values) summed over each node's whole subtree.

    `path` has one row per conversation and depth from 0 on, without gaps: conv_id, depth, node (the smallest conversation through it, which with the
    depth names it) and `values`, set on the row of that conversation and null on the others.
    """
    inside = cut(_in_band(path, values, band))
    if deepest < band:
        return inside
    # band roots, as a trie of their own with a band's total as value
    roots = path.where(F.col("depth") % band == 0).select("conv_id", "depth", "node")
    totals = inside.where(F.col("depth") % band == 0)
    stands = roots.where("conv_id = node").join(totals, ["node", "depth"]).select("conv_id", "depth", *values)
    above = cut(roots.join(stands, ["conv_id", "depth"], "left").withColumn("depth", (F.col("depth") / band).cast("long")))
    done = rolled_up(above, values, deepest // band, band).withColumn("depth", F.col("depth") * band)
    done = cut(done)
    # a completed root adds its total to its ancestors in the band above, through the path of the conversation it is named after
    lower = done.where("depth > 0").select(F.col("node").alias("conv_id"), (F.col("depth") / band - 1).cast("long").alias("__band"), *values)
    up = path.select("conv_id", "depth", "node", F.floor(F.col("depth") / band).alias("__band")).join(lower, ["conv_id", "__band"]).groupBy("node", "depth").agg(*[F.sum(v).cast("long").alias(v) for v in values])
    return cut(inside.unionByName(up).groupBy("node", "depth").agg(*[F.sum(v).cast("long").alias(v) for v in values]))


def _digests(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) from rows (node, depth, conv_id): ids stream in order through the digest, so none is held."""
    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "depth", "ends_sha256"])

        for b in batches:
            for node, depth, conv in zip(*[b.column(c).to_pylist() for c in ("node", "depth", "conv_id")]):
                if (node, depth) != key:
                    if key is not None:
                        yield out()
                    key, digest = (node, depth), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
        if key is not None:
            yield out()

    return ends.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(run, "node long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), rows of one turn by role and name; null roles and texts count as empty. Rows without a conv_id belong to no
    conversation and are left out. Texts and conversations of any length are taken whole. Repeated rows are turns of their own. An empty table gives an
    empty result; other columns are not read.
    """
    steps, sizes = rebuilt(turns(conversations))
    sizes = cut(sizes)
    steps = keyed(steps)
    nodes = steps.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = cut(nodes)
    root = sizes.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"))  # one row
    first = root.first()["node"]
    names = nodes.select(F.col("depth").alias("__depth"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("node").alias("parent"))
    is_parent = (F.col("depth") - 1 == F.col("__depth")) & (F.col("p1") == F.col("__k1")) & (F.col("p2") == F.col("__k2"))
    linked = nodes.where("depth > 1").join(names, is_parent).select("node", "depth", "parent", "n_convs", "words")
    top = nodes.where("depth = 1").select("node", "depth", F.lit(first).cast("long").alias("parent"), "n_convs", "words")
    whole = linked.unionByName(top).unionByName(root.where("n_convs > 0").select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words")))
    whole = cut(whole)
    children = whole.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = cut(whole.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # every conversation's way down, by the nodes' names; a node's values stand on the row of the conversation it is named after
    named = steps.select("conv_id", "depth", "k1", "k2").join(nodes.select("depth", "k1", "k2", "node"), ["depth", "k1", "k2"]).select("conv_id", "depth", "node")
    at_root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(first).cast("long").alias("node"))
    way = cut(named.unionByName(at_root))
    own = whole.select(F.col("node").alias("conv_id"), "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    path = cut(way.join(own.withColumn("node", F.col("conv_id")), ["conv_id", "depth", "node"], "left"))
    deepest = whole.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    sums = rolled_up(path, ["n_leaves", "saved_tokens"], deepest, band)

    ends = _digests(way.join(sizes.select("conv_id", F.col("size").alias("depth")), ["conv_id", "depth"]).select("node", "depth", "conv_id"))
    out = whole.join(sums, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op11_depth_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda crc, byte: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM turns GROUP BY conv_id
), sizes AS (
  SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), steps AS (
  SELECT s.conv_id, t.pos + 1 AS depth, role, text FROM sizes s JOIN turns t ON t.conv_id = s.base WHERE t.pos < s.taken
  UNION ALL
  SELECT s.conv_id, t.pos - s.h + s.taken + 1, role, text FROM sizes s JOIN turns t ON t.conv_id = s.conv_id WHERE t.pos >= s.h
), paths AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(md5(to_json([role, text])::VARCHAR), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node
  FROM steps
  UNION ALL SELECT conv_id, 0, 0, '' FROM sizes
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, left(node, 32 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
), above AS (
  SELECT d.depth, left(n.node, 32 * d.depth) AS node, n.n_children, (n.n_convs - 1) * n.words AS saved
  FROM full_nodes n, (SELECT DISTINCT depth FROM nodes) d WHERE d.depth <= n.depth
), sums AS (
  SELECT depth, node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL
), lasts AS (
  SELECT depth, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = left(n.node, 32 * (n.depth - 1))
LEFT JOIN lasts l ON l.depth = n.depth AND l.node = n.node"""
