"""Work that many rows of one kind must not put into one task or hold at once."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from trabecula.llm import block_naming, common, simhash


def test_pairs_of_a_shared_header_are_spread(spark):
    pairs = spark.range(4000).select(F.lit(7 << 40).alias("ra"), (F.col("id") % 2000 + (3 << 40)).alias("rb"))
    named = block_naming.name_contents(pairs, []).collect()
    assert len({r.name for r in named}) == len(named) == 2000 and not any(r.clash for r in named)
    assert len({r.name >> 40 for r in named}) > 1500


def test_a_full_bucket_of_near_copies_keeps_labels_only():
    n, rnd = 6000, np.random.default_rng(3)
    fp = np.full(n, 12345, np.uint64) ^ (np.uint64(1) << rnd.integers(40, 64, n).astype(np.uint64))
    rows = {"start": np.zeros(n, np.int64), "fp": fp, "node": np.arange(n), "group": np.zeros(n, np.int64), "side": np.full(n, -1)}
    tracemalloc.start()
    a, b = simhash._bucket_links(rows, simhash.Ring(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == n - 1 and set(b.tolist()) == {0}
    assert peak < 20e6


def test_a_key_filter_loses_no_key_and_leaves_others_out(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"), F.concat(F.lit("x"), F.col("id")).alias("s"))
    keys = rows.where("k % 100 = 0")
    held = {r.k for r in common.held(rows, keys, "k", "s").collect()}
    assert held >= set(range(0, 20000, 100)) and len(held) < 210
    nulls = spark.createDataFrame([(None, "a"), (2, None), (3, "b")], "k long, s string")
    assert common.held(nulls, nulls.where("s = 'a'"), "k", "s").count() == 1
    assert common.held(nulls, nulls.limit(0), "k", "s").isEmpty()


def test_contents_are_shuffled_once(spark):
    rows = spark.range(1000).select(F.col("id").alias("ra"), F.col("id").alias("rb"), F.col("id").cast("string").cast("binary").alias("block"))
    named = block_naming.name_contents(rows, ["block"])
    plan = named._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(__b", 1)
    assert "block" not in above and "block" in below and named.where("clash").isEmpty()
    clash = spark.createDataFrame([(1, 1, b"a"), (1, 1, b"b"), (2, 2, b"c"), (2, 2, b"c")], "ra long, rb long, block binary")
    assert sorted((r.ra, r.clash) for r in block_naming.name_contents(clash, ["block"]).collect()) == [(1, True), (2, False)]
