import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trabecula.functions import gates, names, units
from trabecula.functions.core import order_bucket
from trabecula.operators import dedupe, fit, folds, link, quality, score, search, setops
from trabecula.sources import text_files
from trabecula.operators.ordered import exact_quantiles, interval_join, running_total


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- ordered work -------------------------------------------------------------------------------

def test_running_total_with_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
                                  "id", (F.col("id") * 37 % 1009 / 7.0).alias("v"))
    got = running_total(df, ["k"], ["v", "id"], order_bucket("v"), out="pos", total="n").toPandas()
    want = got.sort_values(["k", "v", "id"]).groupby("k").cumcount() + 1
    assert (got.sort_values(["k", "v", "id"])["pos"].to_numpy() == want.to_numpy()).all()
    assert (got.groupby("k")["n"].first() == got.groupby("k").size()).all()


def test_quantiles_match_numpy_including_duplicates_and_signs(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": np.repeat([1.5, -2.0, 0.0], 40), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("a", float("nan"))], "k string, v double")
    for r in exact_quantiles(df, ["k"], "v", [0.0, 0.3, 0.99, 1.0], ["q0", "q3", "q99", "q1"], "n").collect():
        assert r["n"] == len(data[r["k"]])
        assert [r["q0"], r["q3"], r["q99"], r["q1"]] == pytest.approx(list(np.percentile(data[r["k"]], [0, 30, 99, 100])))


def test_quantiles_of_many_keys_sort_the_small_ones(spark, monkeypatch):
    """Small keys are sorted whole in one shuffle of the rows, large ones go by buckets, to the same values; null keys count, null and NaN values don't."""
    from trabecula.operators import ordered
    k = F.when(F.col("id") % 7 != 0, F.col("id") % 7).alias("k")
    df = spark.range(700).select(k, F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.sin("id") * 100).alias("v"))
    df = df.where((F.col("k") != 3) | F.col("k").isNull() | (F.col("v") < 0))
    args = (["k"], "v", [0.0, 0.3, 0.5, 0.99, 1.0], ["a", "b", "c", "d", "e"], "n")
    want = {r["k"]: r for r in exact_quantiles(df, *args).collect()}
    assert len(want) == 7 and None in want
    counts = sorted(r["n"] for r in want.values())
    for limit in (counts[0], counts[-1]):
        monkeypatch.setattr(ordered, "BUCKET_ROWS", limit)
        if limit == counts[-1]:
            monkeypatch.setattr(ordered, "with_bucket", lambda *a: pytest.fail("buckets for small keys"))
        got = exact_quantiles(df, *args, many=True).collect()
        assert {r["k"]: r["n"] for r in got} == {key: r["n"] for key, r in want.items()}
        assert all(list(r)[1:] == pytest.approx(list(want[r["k"]])[1:]) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=2, max_size=2))
def test_order_bucket_rule_never_decreases(pair):
    def bucket(v):
        if v == 0:
            return 0
        m = math.floor(math.log2(abs(v)) * 1024) + 1100 * 1024
        return m if v > 0 else -m
    lo, hi = sorted(pair)
    assert bucket(lo) <= bucket(hi)


def test_interval_join_equals_brute_force(spark):
    random.seed(1)
    pts = [(i, random.uniform(0, 10)) for i in range(200)]
    spans = [(j, a, a + random.uniform(0, 1)) for j, a in enumerate(random.uniform(0, 10) for _ in range(60))]
    got = interval_join(spark.createDataFrame(pts, "i int, x double"), "x", spark.createDataFrame(spans, "j int, lo double, hi double"), "lo", "hi", 0.3)
    assert rows(got, "i", "j") == sorted((i, j) for i, x in pts for j, lo, hi in spans if lo <= x < hi)


# ---- folds --------------------------------------------------------------------------------------

def greedy(sizes, n):
    load, out = [0] * n, []
    for s in sorted(sizes, reverse=True):
        f = load.index(min(load))
        out.append(f)
        load[f] += s
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120), st.integers(1, 7))
def test_phases_equal_the_greedy_loop(sizes, n):
    hist = {}
    for s in sizes:
        hist[s] = hist.get(s, 0) + 1
    got = []
    for size, first, last, cycle in folds.balance_phases(list(hist.items()), n):
        got += [cycle[(p - first) % len(cycle)] for p in range(first, last)]
    assert got == greedy(sizes, n)


def test_phases_do_not_walk_over_groups():
    p = folds.balance_phases([(10**12, 1), (1, 10**12)], 5)
    assert len(p) < 12 and p[-1][2] == 10**12


def test_groups_never_span_folds_and_order_does_not_matter(spark):
    df = spark.range(500).select((F.col("id") * 7 % 61).cast("string").alias("g"), "id")
    a = folds.fold_map(df, "g", 5)
    assert rows(a, "g", "fold") == rows(folds.fold_map(df.orderBy(F.rand(1)), "g", 5), "g", "fold")
    placed = folds.apply_folds(df, "g", a)
    assert placed.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert placed.where("fold < 0").count() == 0 and placed.count() == 500
    unknown = spark.createDataFrame([("zz", 1)], "g string, id long")
    assert folds.apply_folds(unknown, "g", a).first()["fold"] == -1


def test_single_row_strata_stay_in_training(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "s string, id long")
    out = folds.stratified_holdout(df, "s", "id", 0.5, 1)
    assert rows(out.groupBy("s").agg(F.count_if("is_test").alias("t")), "s", "t") == [("a", 0), ("b", 1)]


def test_validation_groups_leave_the_last_group(spark):
    df = spark.createDataFrame([("a", 1)], "g string, id long")
    assert folds.validation_groups(df, "g", 0.5, 1).count() == 0
    two = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "g string, id long")
    assert folds.validation_groups(two, "g", 0.9, 1).count() == 1


def test_stratum_choice():
    class T:
        columns = ["family", "topology"]
    assert folds.stratum_column(T, "variant") == "topology" and folds.stratum_column(T, "family") == "family"


# ---- versions and links -------------------------------------------------------------------------

def test_latest_version_ties_and_spelling(spark):
    df = spark.createDataFrame([("a.STL", "v2", 1, 1.0), ("a", "v2", 2, 2.0), ("a", "v1", 3, 3.0), ("", "v9", 4, 4.0), (None, "v9", 5, 5.0), ("b", None, 6, 6.0)],
                               "Run string, Version string, seq int, x double")
    assert rows(dedupe.latest_version(df), "Run", "x") == [("a", 2.0), ("b", 6.0)]


def test_params_link_treats_nulls_as_equal(spark):
    f = spark.createDataFrame([("s1", 1.0, None), ("s2", 2.0, 5), ("s3", 9.0, None)], "stem string, a double, b int")
    l = spark.createDataFrame([("s2", 7.0, 7, 1, 10.0), ("old", 1.0, None, 2, 20.0), ("new", 1.0, None, 3, 30.0)], "Run string, a double, b int, seq int, y double")
    out = link.link_by_params(f, l, "stem", "Run", ["a", "b"], "seq")
    assert rows(out.fillna("-", ["matched_run"]), "stem", "matched_run", "match_kind") == [("s1", "new", "params"), ("s2", "s2", "exact"), ("s3", "-", "none")]


def test_alias_fills_gaps_only(spark):
    ix = spark.createDataFrame([("P", 1, "short"), ("P Generator", 1, "full"), ("D", 1, "d")], "topology string, k int, path string")
    out = link.with_aliases(ix, "topology", ["k"], ["path"])
    assert rows(out, "topology", "path") == [("D", "d"), ("D Generator", "d"), ("P", "short"), ("P Generator", "full")]


def test_guard_verdicts(spark):
    def verdict(flags):
        return link.match_guard(spark.createDataFrame([(f,) for f in flags], "m boolean"), "m").first()["verdict"]
    assert verdict([]) == "empty input" and verdict([False]) == "nothing joined"
    assert verdict([True] * 3 + [False]) == "too many unmatched" and verdict([True] * 4 + [False]) == "ok"


def test_nearest_ties_ends_and_single_row(spark):
    t = spark.createDataFrame([(1, 0.15), (2, -5.0), (3, 99.0), (4, 0.2), (5, None)], "id int, x double")
    lk = spark.createDataFrame([(0.1, 1.0), (0.2, 2.0), (0.4, 4.0)], "density double, t double")
    out = {r["id"]: (r["near_density"], r["near_t"]) for r in link.nearest(t, "x", lk, "density", ["t"]).collect()}
    assert out == {1: (0.1, 1.0), 2: (0.1, 1.0), 3: (0.4, 4.0), 4: (0.2, 2.0), 5: (None, None)}
    one = link.nearest(t, "x", lk.limit(1), "density").where("id = 3").first()
    assert one["near_density"] is not None


def test_curve_inversion_refuses_outside(spark):
    c = spark.createDataFrame([("g", 1.0, 0.1), ("g", 2.0, 0.2), ("g", 4.0, 0.3)], "topo string, t double, vf double")
    p = spark.createDataFrame([("g", 0.15), ("g", 0.2), ("g", 0.3), ("g", 0.31), ("h", 0.15)], "topo string, rho double")
    out = {(r["topo"], r["rho"]): r["t_solved"] for r in link.invert_curve(p, "rho", c, keys=["topo"]).collect()}
    assert out[("g", 0.15)] == pytest.approx(1.5) and out[("g", 0.2)] == pytest.approx(2) and out[("g", 0.3)] == pytest.approx(4)
    assert out[("g", 0.31)] is None and out[("h", 0.15)] is None


def test_contained_link_both_ways(spark):
    f = spark.createDataFrame([("abc",), ("xabcdx",), ("zzz",)], "stem string")
    n = spark.createDataFrame([("abcd",), ("bc",), ("q",)], "name string")
    out = link.link_contained(f, "stem", n, "name")
    assert rows(out.fillna("-"), "stem", "matched_name", "match_kind") == [("abc", "abcd", "contains"), ("xabcdx", "abcd", "contains"), ("zzz", "-", "none")]


def test_seed_labels_repeat(spark):
    df = spark.createDataFrame([("20260801_0100",), ("20260802_0100_seed1",), ("20260803_0100_SEED-3",), ("20260804_0100",)], "run string")
    assert [r["label"] for r in dedupe.unique_labels(df, "run").orderBy("run").collect()] == ["seed 1", "seed 1 (2)", "seed 3", "seed 1 (3)"]


@pytest.mark.parametrize("n,want", [(1, [0]), (2, [0, 9]), (4, [0, 3, 6, 9]), (10, list(range(10))), (99, list(range(10)))])
def test_even_sample(spark, n, want):
    df = spark.range(10)
    assert sorted(r["id"] for r in dedupe.evenly_spaced(df, n, ["id"], F.col("id")).collect()) == want


# ---- gates, names, units ------------------------------------------------------------------------

def test_unknown_gate_passes(spark):
    df = spark.createDataFrame([(True, None, True), (True, False, True), (True, True, None)], "gate2 boolean, gate3 boolean, gate4 boolean")
    assert [r["e"] for r in df.select(gates.eligible().alias("e")).collect()] == [True, False, False]


def test_holdout_language(spark):
    df = spark.createDataFrame([("Gyroid ", 0.15), ("P", 0.25), (None, None)], "topology string, VF double")
    def n(spec):
        f = gates.holdout_filter(df, gates.parse_holdouts([spec])[0])
        return None if f is None else df.where(f).count()
    assert [n(s) for s in ("a|topology|Gyroid", "a|VF|>=0.25", "a|VF|<0.2", "a|VF|0.15..0.2", "a|VF|0.25", "a|gone|1", "a|VF|>x")] == [1, 1, 1, 1, 1, None, None]
    assert gates.parse_holdouts(["two|fields", "", "a|b|c"]) == [gates.Holdout("a", "b", "c")]


def test_names(spark):
    df = spark.createDataFrame([("LAT_flow_i15p0_d22p85_t0p4_m1p6_s3",), ("5cube_seed",), ("LAT RAW_i9_d3",), ("junk",)], "s string")
    p = [r["p"].asDict() for r in df.select(names.parse_stem("s", "LAT").alias("p")).collect()]
    assert p[0] == {"variant": "flow", "inner": 15.0, "density": 22.85, "t": 0.4, "seed": 3, "size_multi": 1.6}
    assert p[1] == {"variant": "df", "inner": 15.0, "density": None, "t": 0.4, "seed": 2, "size_multi": 1.6}
    assert p[2]["variant"] == "raw" and p[2]["inner"] == 9.0 and p[3]["variant"] == "df"
    b = spark.range(1).select(names.build_stem("LAT", F.lit(15.0), F.lit(22.85), F.lit(None).cast("double"), F.lit(2), F.lit(1.6)).alias("s")).first()["s"]
    assert b == "LAT_i15p0_d22p85_s2_m1p6"
    k = spark.range(1).select(names.build_stem("ID2", F.lit(15.0), F.lit(22.0), F.lit(0.4), F.lit(2), F.lit(1.6), {"inner": 1, "multi": 1}, keep_zeros=True).alias("s")).first()["s"]
    assert k == "ID2_i15p0_d22p00_t0p40_s2_m1p6"
    n = spark.createDataFrame([("P_density0.15",), ("none",), ("a1b.5",)], "s string").select(names.last_number("s").alias("n"))
    assert [r["n"] for r in n.collect()] == [0.15, None, 0.5]


def test_units():
    assert units.unit_factor("kPa") == 1e-6 and units.unit_factor("GPa", "mpa") == pytest.approx(1000) and units.unit_factor("-") == 1
    with pytest.raises(ValueError):
        units.unit_factor("psi")


def test_default_labels(spark):
    df = spark.createDataFrame([("r", "0.1", 20.0, 5.0)], "Run string, E_over_Es string, C11_GPa double, Yield_onset_MPa double")
    r = units.normalise_labels(df, keep=["Run"]).first()
    assert (r["E_over_Es"], r["C11_n"], r["onset_n"], r["TAI"]) == (0.1, pytest.approx(0.1), pytest.approx(0.02), None)


# ---- scores and fits ----------------------------------------------------------------------------

def test_score_edges(spark):
    df = spark.createDataFrame([("c", 0.1, 0.2)] * 3 + [("z", 0.0, 1.0), ("z", 1.0, 1.0), ("z", 2.0, 2.0), ("s", 1.0, 1.0), ("n", None, 1.0)],
                               "target string, y_true double, y_pred double").withColumn("model", F.lit("RF"))
    r = {x["target"]: x for x in score.score(df).collect()}
    assert set(r) == {"c", "z"} and r["c"]["R2"] is None and r["c"]["MAPE"] == pytest.approx(100)
    assert r["z"]["R2"] == pytest.approx(0.5) and r["z"]["MAPE"] == pytest.approx(0)


def test_power_fit_recovers_law(spark):
    df = spark.range(1, 30).select(F.lit("df").alias("v"), (F.col("id") / 100.0).alias("rho")).withColumn("E", 0.863 * F.pow("rho", F.lit(1.83)))
    r = fit.power_fit(df, "rho", "E", ["v"]).first()
    assert (r["coefficient"], r["exponent"], r["r2"]) == (pytest.approx(0.863), pytest.approx(1.83), pytest.approx(1))
    assert fit.power_fit(df.limit(2), "rho", "E", ["v"]).count() == 0 and fit.power_fit(df.limit(2), "rho", "E").count() == 0


def test_skew_needs_rows(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(7)] + [(None, 1.0)], "a double, b double")
    assert rows(quality.skew_report(df, ["a", "b"]), "feature") == [("b",)]


def test_leak_without_reference_density_fails(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.2)], "watertight int, VF double")
    assert quality.leak_rule(df).first()["verdict"] == "fail"


def test_merge_guard(spark):
    a = spark.createDataFrame([(1.0, 2.0)], "E_over_Es double, TAI double")
    g = {r["guard"]: r["severity"] for r in setops.merge_guard(a, a.drop("TAI"), ["E_over_Es", "TAI"], 0.3, 0.33, "quadratic", "linear").collect()}
    assert g == {"shared targets": "fail", "poisson ratio": "fail", "element order": "warn"}
    g = {r["guard"]: r["severity"] for r in setops.merge_guard(a, a, ["TAI"], 0.3, 0.3, "Linear", "linear").collect()}
    assert set(g.values()) == {"ok"}


def test_column_difference(spark):
    a, b = spark.range(1).selectExpr("1 AS x", "2 AS y"), spark.range(1).selectExpr("1 AS x", "3 AS z")
    assert rows(setops.column_difference(a, b), "column", "side") == [("x", "shared"), ("y", "left only"), ("z", "right only")]


def test_outputs_later_entry_wins(spark):
    text = '[{"name":"Average_Mn_K","value":1.5},{"name":"Average_Mn_K","value":{"val":2.5}},{"name":"Other","value":"x"},{"name":"flag","value":true}]'
    df = spark.createDataFrame([("r", text), ("bad", "{")], "run string, value string")
    assert rows(text_files.read_outputs(df, ["run"]), "quantity", "value") == [("average_mn_k", 2.5), ("gausscurv", 2.5)]


def test_keep_first_prefers_into(spark):
    a = spark.createDataFrame([("E", "s", "m", 1.0)], "target string, split string, model string, R2 double")
    b = spark.createDataFrame([("E", "s", "m", 2.0), ("E", "t", "m", 3.0)], a.schema)
    out = setops.union_keep_first(a, b, ["target", "split", "model"], "new", "old")
    assert rows(out, "split", "R2", "from_run") == [("s", 1.0, "new"), ("t", 3.0, "old")]


# ---- search -------------------------------------------------------------------------------------

def test_no_overlap_fails_gate1(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "family string, v double")
    assert search.domain_overlap(df, "family", "v", 2.5).first()["gate1"] is False


def test_tie_band_edges(spark):
    df = spark.createDataFrame([("far", 0.2, 0.0), ("in_high", 0.104, 0.5), ("in_low", 0.097, 0.3), ("in_none", 0.1, None), ("unknown", None, 0.1)], "stem string, p double, tai double")
    order = [r["stem"] for r in search.rank_candidates(df, "p", 0.1, "tai").orderBy("rank").collect()]
    assert order == ["in_low", "in_high", "in_none", "far", "unknown"]
    top = [r["stem"] for r in search.rank_candidates(df, "p", 0.1, "tai", goal="max").orderBy("rank").collect()][:2]
    assert top == ["in_high", "in_low"]
    none_in = search.rank_candidates(df.where("stem = 'far'"), "p", 0.1, "tai").first()
    assert none_in["rank"] == 1 and not none_in["in_band"]
