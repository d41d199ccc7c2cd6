import pytest
from pyspark.sql import functions as F

from trabecula.functions.gates import Holdout
from trabecula.learn import forest
from trabecula.plans import dataset, evaluate, inverse_search


def test_aperiodic_dataset(spark):
    feats = spark.createDataFrame([("LAT_df_i15p0_d20p0_t0p4_m1p6_s2.stl", "OK", 0.10), ("LAT_df_i15p0_d20p0_t0p4_m1p6_s3.stl", "OK", 0.11), ("LAT_flow_i15p0_d20p0_t0p4_m1p6_s2.STL", "OK", 0.2),
                                   ("broken.stl", "ERROR x", 0.3), ("LAT_df_i9p0_d1p0.stl", "OK", 0.4), ("LAT_raw_i1p0_d1p0.stl", "OK", 0.5)], "file string, status string, VF double")
    master = spark.createDataFrame([("LAT_df_i15p0_d20p0_t0p4_m1p6_s2", "v1", "OK", 9.0, 0.05, 1), ("LAT_df_i15p0_d20p0_t0p4_m1p6_s2", "v2", "OK", 10.0, 0.06, 2),
                                    ("LAT_df_i15p0_d20p0_t0p4_m1p6_s3", "v1", "OK", 11.0, 0.07, 3), ("LAT_flow_i15p0_d20p0_t0p4_m1p6_s2.stl", "v1", "OK", 12.0, 0.08, 4),
                                    ("LAT_df_i9p0_d1p0", "v1", "FAIL", None, None, 5)], "Run string, Version string, Status string, C11_GPa double, E_over_Es double, seq int")
    out = {r["Run"]: r for r in dataset.aperiodic_dataset(feats, master, "LAT").collect()}
    assert set(out) == {"LAT_df_i15p0_d20p0_t0p4_m1p6_s2", "LAT_flow_i15p0_d20p0_t0p4_m1p6_s2"}
    assert out["LAT_df_i15p0_d20p0_t0p4_m1p6_s2"]["E_over_Es"] == 0.06 and out["LAT_df_i15p0_d20p0_t0p4_m1p6_s2"]["C11_n"] == pytest.approx(0.05)
    assert out["LAT_flow_i15p0_d20p0_t0p4_m1p6_s2"]["variant"] == "flow"


def test_periodic_and_combined_dataset(spark):
    iso = [[0.0] * 6 for _ in range(6)]
    for i in range(3):
        for j in range(3):
            iso[i][j] = 40.0 if i == j else 20.0
        iso[i + 3][i + 3] = 10.0
    c = [x for r in iso for x in r]
    tensors = spark.createDataFrame([("P", 0.15, "a", c), ("D", 0.2, "b", c), ("X", 0.2, "x", c)], "topology string, density double, path string, c array<double>")
    feats = spark.createDataFrame([("P Generator", "P_density0.15.stl", "OK", 0.151, 20.0), ("D", "D_0.2.stl", "OK", 0.5, 20.0), ("X", "X_0.2.stl", "OK", 0.2, 20.0), ("P", "P_0.9.stl", "OK", 0.9, 1.0), ("P", "P_0.15.stl", "ERROR", 0.15, 1.0)],
                                  "topology string, file string, status string, VF double, SAV_x_cell double")
    data, rejected, missed = dataset.periodic_dataset(feats, tensors, "MPa", 1800.0, "MPa", 0.3, excluded=["X"], element_order="quadratic")
    r = data.collect()
    assert [x["Run"] for x in r] == ["P_density0.15"] and r[0]["TAI"] == pytest.approx(0, abs=1e-9) and r[0]["group_key"] == "periodic|P Generator|7"
    assert [x["file"] for x in rejected.collect()] == ["D_0.2.stl"]
    assert sorted(x["file"] for x in missed.collect()) == ["P_0.9.stl", "X_0.2.stl"]
    a = spark.createDataFrame([("r", "flow", 0.2, 15.0, 0.21, 0.1)], "Run string, variant string, VF double, SAV_x_cell double, Rho_rel double, E_over_Es double")
    both = dataset.combined_dataset(a, data, "aperiodic", "periodic", 3.0, 10.0).collect()
    assert sorted((x["family"], x["topology"], x["group_key"]) for x in both) == [("aperiodic", "flow", "aperiodic|flow|10"), ("periodic", "P Generator", "periodic|P Generator|7")]
    assert {x["family"]: x["L_star_mm"] for x in both}["aperiodic"] == pytest.approx(1 / (15 / 3 * 0.2))


def test_cross_validation_and_holdouts(spark):
    df = spark.range(240).select((F.col("id") % 24).cast("string").alias("g"), F.col("id").alias("Run"), (F.col("id") % 40 / 100 + 0.05).alias("VF"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("E", 0.8 * F.pow("VF", F.lit(1.8)))
    p = evaluate.cross_validate(df, "g", ["VF", "b"], ["E"], 4, ["Run"], trees=5, depth=5).cache()
    s, pivot = evaluate.evaluate(p, ["RF", "density only"])
    r = {x["model"]: x for x in s.collect()}
    assert r["density only"]["R2"] == pytest.approx(1) and r["RF"]["R2"] > 0.8 and r["RF"]["N"] == 240
    assert pivot.columns == ["target", "RF", "density only"]
    h = forest.holdout_predictions(df, ["VF"], "E", [Holdout("high", "VF", ">=0.3"), Holdout("none", "VF", ">=9"), Holdout("all", "VF", ">=0")], ["Run"], trees=3, depth=3)
    assert {x["split"] for x in h.select("split").distinct().collect()} == {"high"}
    fitted = forest.regressor(["VF", "b"], "E", trees=5, depth=4).fit(df)
    assert forest.importances(fitted, ["VF", "b"], df).first()["feature"] == "VF"
    broken = df.withColumn("b", F.when(F.col("Run") > 200, F.lit(None)).otherwise(F.col("b")))
    out = forest.score_rows(fitted, broken, ["VF", "b"], ["Run"])
    assert out.where("NOT ok").count() == 39 and out.where("NOT ok").first()["detail"] == "missing b"
    with pytest.raises(ValueError):
        forest.out_of_fold(df.limit(2).withColumn("fold", F.lit(0)), ["VF"], "E", "fold", 2, ["Run"], trees=2)


def test_inverse_design_chain(spark):
    a = spark.createDataFrame([("a1", 0.2, 0.099, 0.4, True, None, True), ("a2", 0.21, 0.1, 0.1, True, False, True), ("a3", 0.3, 0.15, 0.2, True, True, True)],
                              "stem string, p_rel double, pred_E double, pred_TAI double, gate2 boolean, gate3 boolean, gate4 boolean")
    b = spark.createDataFrame([("b1", 0.25, 0.103, 0.3, True, True, True), ("b2", 0.25, 0.101, 0.2, False, True, True)],
                              "stem string, vf double, pred_E double, pred_TAI double, gate2 boolean, gate3 boolean, gate4 boolean")
    ranking, final = inverse_search.rank([("aperiodic", a), ("periodic", b)], "pred_E", 0.1, "pred_TAI")
    assert [r["stem"] for r in ranking.orderBy("rank").collect()] == ["b1", "a1", "a3"]
    assert sorted((r["family"], r["stem"]) for r in final.collect()) == [("aperiodic", "a1"), ("periodic", "b1")]
    measured = spark.createDataFrame([("a1", 0.1, 0.8), ("b1", 0.2, 0.31)], "stem string, E double, TAI double")
    v = {(r["stem"], r["target"]): r["ok"] for r in inverse_search.verify(final, measured, ["stem"], ["E", "TAI"]).collect()}
    assert v == {("a1", "E"): True, ("a1", "TAI"): False, ("b1", "E"): False, ("b1", "TAI"): True}


def test_grid_plan_skips_what_exists(spark):
    c = spark.createDataFrame([("g", 20.0, 0.4, 19.0, 21.0, 0.3, 0.42)], "topo string, D double, t double, d_lo double, d_hi double, t_lo double, t_hi double")
    built = spark.createDataFrame([(20.0, 0.42), (1.0, 1.0)], "D double, t double")
    plan = inverse_search.density_thickness_plan(c, built, 0.1, 0.1, 3, 3)
    got = sorted((r["D"], r["t"]) for r in plan.collect())
    assert len(got) == 8 and (20.0, 0.42) not in got and got[0] == (19.0, 0.36)
