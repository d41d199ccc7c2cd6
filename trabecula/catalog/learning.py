"""Forest regression queries (M1-M4, M7-M9, M11, T8). Fitted numbers have no SQL; the checks are row counts and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.learn import forest
from trabecula.plans import evaluate

_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_SMALL = {"trees": 5, "depth": 4}


def _rows(t):
    return t.lineitem.withColumn("group_key", F.concat_ws("|", "l_returnflag", (F.col("l_partkey") % 50).cast("string")))


@query("forest_out_of_fold", """SELECT 'RF' AS model, count(*) AS n_rows, count(*) AS n_predicted FROM lineitem UNION ALL SELECT 'density only', count(*), count(*) FILTER (l_quantity > 0) FROM lineitem""")
def forest_out_of_fold(t):
    p = evaluate.cross_validate(_rows(t), "group_key", _FEATURES, ["l_extendedprice"], 3, ["l_orderkey", "l_linenumber"], density="l_quantity", **_SMALL)
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.count("y_pred").alias("n_predicted"))


@query("forest_scores")
def forest_scores(t):
    p = evaluate.cross_validate(_rows(t), "group_key", _FEATURES, ["l_extendedprice"], 3, ["l_orderkey"], density="l_quantity", **_SMALL)
    return evaluate.evaluate(p, ["RF", "density only"])[0]


@query("forest_holdouts", "SELECT 'high' AS split, count(*) AS n FROM lineitem WHERE l_quantity >= 40 UNION ALL SELECT 'flag', count(*) FROM lineitem WHERE l_returnflag = 'N'")
def forest_holdouts(t):
    specs = ["high|l_quantity|>=40", "flag|l_returnflag|N", "all|l_quantity|>=0", "gone|nothing|1"]
    p = evaluate.holdouts(t.lineitem, specs, _FEATURES, ["l_extendedprice"], ["l_orderkey"], **_SMALL)
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("forest_importances")
def forest_importances(t):
    fitted = forest.regressor(_FEATURES, "l_extendedprice", scale=True, **_SMALL).fit(t.lineitem)
    return forest.importances(fitted, _FEATURES, t.lineitem)


@query("forest_scoring", "SELECT l_tax > 0.07 OR l_discount > 0.09 AS skipped, count(*) AS n, count(*) FILTER (NOT (l_tax > 0.07 OR l_discount > 0.09)) AS n_predicted FROM lineitem GROUP BY 1")
def forest_scoring(t):
    fitted = forest.regressor(_FEATURES, "l_extendedprice", **_SMALL).fit(t.lineitem)
    rows = t.lineitem.withColumns({"l_tax": F.when(F.col("l_tax") <= 0.07, F.col("l_tax")), "l_discount": F.when(F.col("l_discount") <= 0.09, F.col("l_discount"))})
    out = forest.score_rows(fitted, rows, _FEATURES, ["l_orderkey", "l_linenumber"])
    return out.groupBy((~F.col("ok")).alias("skipped")).agg(F.count(F.lit(1)).alias("n"), F.count("predicted").alias("n_predicted"))


@query("forest_default", """SELECT count(*) AS n_rows, count(*) AS n_predicted, true AS beats_control, true AS weights_sum_to_one, 'p_size' AS first_feature FROM part""")
def forest_default(t):
    """Forests as fitted by default (100 trees of depth 8) on all parts, folds fitted at once (M1-M3, M7-M9, T8): a label that p_size drives in a way no power law has."""
    rows = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 7).alias("noise"), F.concat_ws("|", "p_brand", (F.col("p_partkey") % 20).cast("string")).alias("group_key"),
                         (F.sin(F.col("p_size") / 4.0) * 10 + 20 + F.col("p_retailprice") / 1e6).alias("y")).withColumn("density", F.col("p_size").cast("double"))
    features = ["p_size", "p_retailprice", "noise"]
    p = evaluate.cross_validate(rows, "group_key", features, ["y"], 3, ["p_partkey"], density="density")
    scores = evaluate.evaluate(p, ["RF", "density only"])[0].groupBy().agg(*[F.max(F.when(F.col("model") == m, F.col("R2"))).alias(n) for m, n in (("RF", "forest"), ("density only", "control"))])
    weights = forest.importances(forest.regressor(features, "y").fit(forest.dealt(rows, rows.count())), features, rows)
    w = weights.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("to_one"), F.min_by("feature", "rank").alias("first")).first()
    r = scores.first()
    better = r["forest"] > 0.5 and (r["control"] is None or r["forest"] > r["control"])
    return p.where("model = 'RF'").agg(F.count(F.lit(1)).alias("n_rows"), F.count("y_pred").alias("n_predicted"), F.lit(better).alias("beats_control"),
                                       F.lit(w["to_one"]).alias("weights_sum_to_one"), F.lit(w["first"]).alias("first_feature"))


@query("importance_law", "SELECT count(*) AS n_features, true AS sums_to_one, true AS in_order FROM (VALUES (1), (2), (3)) v(rank) WHERE EXISTS (SELECT 1 FROM lineitem)")
def importance_law(t):
    """The weights of a fitted forest add up to one and come largest first."""
    fitted = forest.regressor(_FEATURES, "l_extendedprice", **_SMALL).fit(t.lineitem)
    w = forest.importances(fitted, _FEATURES, t.lineitem)
    rows = w.agg(F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"), F.array_sort(F.collect_list(F.struct("rank", "importance"))).alias("w"))  # at most four rows
    return rows.select("n_features", "sums_to_one", F.forall(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("w", i - 1)["importance"] >= F.get("w", i)["importance"]).alias("in_order"))
