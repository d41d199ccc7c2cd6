"""Sweeps over ordered values and contains-matching against plain loops."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from trabecula.operators import link
from trabecula.operators.ordered import bracket


def test_bracket_equals_a_loop(spark):
    rnd = random.Random(3)
    knots = {(k, v) for k in ("a", "b", None) for v in [rnd.uniform(-5, 5) for _ in range(40)] + [1e9, -1e12, 0.0]} | {("c", 2.0)}
    points = [(i, rnd.choice(["a", "b", None, "c", "none"]), rnd.choice([rnd.uniform(-6, 6), 0.0, 1e9, 2.0, None, 3e9])) for i in range(600)]
    got = bracket(spark.createDataFrame(points, "i int, k string, x double"), "x", spark.createDataFrame(list(knots), "k string, at double"), "at", ["k"])
    seen = 0
    for r in got.collect():
        own = sorted(v for k, v in knots if k == r["k"])
        cut = bisect.bisect_right(own, r["x"]) if r["x"] is not None else None
        want = (None, None) if cut is None else (own[cut - 1] if cut else None, own[cut] if cut < len(own) else None)
        assert (r["before"]["at"] if r["before"] else None, r["after"]["at"] if r["after"] else None) == want
        seen += 1
    assert seen == len(points)


def test_a_shared_value_is_looked_up_once_and_outliers_cost_nothing(spark):
    targets = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.col("id") / 1000.0).alias("x"))
    lookup = spark.range(0, 300).select((F.col("id") * 1.0).alias("v"))
    def spent(extra):
        t0 = time.perf_counter()
        n = link.nearest(targets, "x", lookup.unionByName(spark.createDataFrame(extra, "v double")), "v").where(F.abs(F.col("near_v") - F.col("x")) > 0.5).count()
        return n, time.perf_counter() - t0
    spent([(1.5,)])
    (n, plain), (m, far) = spent([(1.5,)]), spent([(1e9,)])
    assert n == m == 0 and far < 3 * plain + 2


def test_inverted_curves_with_ties_and_empty_points(spark):
    curve = [("g", 1.0, 0.1), ("g", 2.0, 0.2), ("g", 3.0, 0.2), ("g", 5.0, 0.4), ("g", None, 0.3), ("g", 9.0, None), ("one", 4.0, 1.0), ("g", 7.0, 1e9)]
    points = [("g", 0.15), ("g", 0.2), ("g", 0.3), ("g", 0.4), ("g", 0.05), ("one", 1.0), ("one", 1.1), ("g", None), (None, 0.2), ("g", 5e8)]
    got = link.invert_curve(spark.createDataFrame(points, "k string, rho double"), "rho", spark.createDataFrame(curve, "k string, t double, vf double"), keys=["k"]).collect()
    out = {(r["k"], r["rho"]): r["t_solved"] for r in got}
    assert out["g", 0.15] == pytest.approx(1.5) and out["g", 0.2] == pytest.approx(3) and out["g", 0.3] == pytest.approx(4) and out["g", 0.4] == pytest.approx(5)
    assert out["g", 0.05] is None and out["one", 1.0] == pytest.approx(4) and out["one", 1.1] is None and out["g", None] is None and out[None, 0.2] is None
    assert out["g", 5e8] == pytest.approx(6, abs=1e-6) and len(got) == len(points)


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_equals_all_pairs(spark, seed):
    rnd = random.Random(seed)
    word = lambda lo, hi: "".join(rnd.choices("abcd_", k=rnd.randrange(lo, hi)))
    stems, names = {word(0 if seed == 2 else 1, 9) for _ in range(60)}, {word(1, 14) for _ in range(60)} | {"é日本語x"}
    stems |= {"日本語", "zz", "zzzzz"}
    got = link.link_contained(spark.createDataFrame([(s,) for s in stems] + [(None,)], "s string"), "s", spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n").collect()
    assert len(got) == len(stems) + 1
    for r in got:
        want = min((n for n in names if r["s"] is not None and (r["s"] in n or n in r["s"])), default=None)
        assert r["matched_name"] == want, r


def test_a_gram_in_all_names_meets_one(spark):
    names = spark.range(5000).select(F.concat(F.lit("abc"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("n"))
    stems = spark.createDataFrame([("abc",), ("c00012",), ("a",), ("",)], "s string")
    got = link.contained_pairs(stems, "s", names, "n").collect()
    assert sorted((r["s"], r["n"]) for r in got) == [("", "abc00000"), ("a", "abc00000"), ("abc", "abc00000"), ("c00012", "abc00012")]
