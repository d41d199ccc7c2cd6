"""Scoring queries: line items stand for predictions (y = price, prediction = quantity x constant)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions import gates
from trabecula.operators import link, score

_PRED = """p AS (SELECT l_linestatus AS target, l_returnflag AS model, l_extendedprice AS y, l_quantity * 2000.0 AS p, l_discount AS vf,
  l_linenumber AS run_no, l_orderkey % 5 AS fold, year(l_shipdate) AS yr, l_partkey FROM lineitem)"""
_R2 = "1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0)"
_MAPE = "avg(CASE WHEN abs(y) > 1e-9 THEN abs((p - y) / y) END) * 100"


def _pred(t):
    return t.lineitem.select(F.col("l_linestatus").alias("target"), F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y_true"),
                             (F.col("l_quantity") * 2000.0).alias("y_pred"), F.col("l_discount").alias("VF"), F.col("l_linenumber").alias("run_no"),
                             (F.col("l_orderkey") % 5).alias("fold"), F.year("l_shipdate").alias("yr"), "l_partkey")


def _r(df, *cols, d=6):
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("score_by_model", f"WITH {_PRED} SELECT target, model, count(*) AS N, round({_R2}, 6) AS R2, round({_MAPE}, 6) AS MAPE FROM p GROUP BY 1, 2 HAVING count(*) >= 3")
def score_by_model(t):
    return _r(score.score(_pred(t)), "R2", "MAPE")


@query("score_density_band", f"WITH {_PRED} SELECT target, model, count(*) AS N, round({_R2}, 6) AS R2, round({_MAPE}, 6) AS MAPE FROM p WHERE vf >= 0.02 AND vf < 0.05 GROUP BY 1, 2 HAVING count(*) >= 3")
def score_density_band(t):
    return _r(score.score_band(_pred(t), 0.02, 0.05), "R2", "MAPE")


@query("score_all_bands", f"""WITH {_PRED}, b AS (SELECT *, CASE WHEN vf < 0.03 THEN 0.0 WHEN vf < 0.06 THEN 0.03 WHEN vf < 0.09 THEN 0.06 ELSE NULL END::DOUBLE AS band FROM p WHERE vf >= 0)
SELECT target, model, band, count(*) AS N, round({_R2}, 6) AS R2, round({_MAPE}, 6) AS MAPE FROM b WHERE band IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def score_all_bands(t):
    return _r(score.score_bands(_pred(t), [0.0, 0.03, 0.06, 0.09]), "R2", "MAPE")


@query("score_small_groups", f"WITH {_PRED} SELECT l_partkey, fold, count(*) AS N, round({_R2}, 5) AS R2, round({_MAPE}, 5) AS MAPE FROM p GROUP BY 1, 2 HAVING count(*) >= 3")
def score_small_groups(t):
    return _r(score.score(_pred(t), ["l_partkey", "fold"]), "R2", "MAPE", d=5)


@query("fold_scores", f"WITH {_PRED} SELECT run_no, target, fold, count(*) AS N, round({_R2}, 6) AS R2 FROM p GROUP BY 1, 2, 3 HAVING count(*) > 2")
def fold_scores(t):
    return _r(score.fold_scores(_pred(t), ["run_no", "target", "fold"]), "R2")


_SPREAD = f"""WITH {_PRED}, s AS (SELECT target, run_no, {_R2} AS r2 FROM p GROUP BY 1, 2 HAVING count(*) > 2),
sp AS (SELECT target, count(r2) AS n_runs, avg(r2) AS mean, max(r2) - min(r2) AS spread, CASE WHEN count(r2) > 1 THEN stddev_samp(r2) ELSE 0 END AS sd, min(r2) AS lo, max(r2) AS hi FROM s GROUP BY 1)"""


@query("seed_spread", _SPREAD + " SELECT target, n_runs, round(mean, 6) AS mean, round(spread, 6) AS spread, round(sd, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi FROM sp")
def seed_spread(t):
    return _r(score.seed_spread(_pred(t), run="run_no"), "mean", "spread", "sd", "lo", "hi")


@query("widest_spread", _SPREAD + " SELECT arg_max(target, spread) AS target, round(max(spread), 6) AS spread FROM sp")
def widest_spread(t):
    return _r(score.widest(score.seed_spread(_pred(t), run="run_no")), "spread")


@query("score_pivot", f"WITH {_PRED}, s AS (SELECT target, model, {_R2} AS r2 FROM p GROUP BY 1, 2) SELECT target, round(avg(r2) FILTER (model = 'A'), 6) AS A, round(avg(r2) FILTER (model = 'N'), 6) AS N, round(avg(r2) FILTER (model = 'R'), 6) AS R FROM s GROUP BY 1")
def score_pivot(t):
    return _r(score.score_pivot(score.score(_pred(t)), ["A", "N", "R"]), "A", "N", "R")


@query("compare_before_after", f"""WITH {_PRED}, b AS (SELECT target, model, {_R2} AS r2, {_MAPE} AS m FROM p WHERE yr <= 1998 GROUP BY 1, 2 HAVING count(*) >= 3),
a AS (SELECT target, model, {_R2} AS r2, {_MAPE} AS m FROM p WHERE yr > 1998 AND model <> 'R' GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT coalesce(a.target, b.target) AS target, coalesce(a.model, b.model) AS model, round(b.r2, 6) AS R2_before, round(b.m, 6) AS MAPE_before,
 round(a.r2, 6) AS R2_after, round(a.m, 6) AS MAPE_after, round(a.r2 - b.r2, 6) AS R2_delta, round(a.m - b.m, 6) AS MAPE_delta
FROM b FULL JOIN a ON a.target = b.target AND a.model = b.model""")
def compare_before_after(t):
    p = _pred(t)
    out = link.compare_full(score.score(p.where("yr <= 1998")), score.score(p.where("yr > 1998 AND model <> 'R'")), ["target", "model"], ["R2", "MAPE"])
    return _r(out, *[c for c in out.columns if c not in ("target", "model")])


@query("compare_schemes", f"""WITH {_PRED}, a AS (SELECT fold AS target, {_R2} AS r2 FROM p WHERE model <> 'N' GROUP BY 1), b AS (SELECT fold AS target, {_R2} AS r2 FROM p WHERE model = 'N' AND fold > 0 GROUP BY 1)
SELECT coalesce(a.target, b.target) AS target, round(a.r2, 6) AS R2_before, round(b.r2, 6) AS R2_after, round(b.r2 - a.r2, 6) AS R2_delta FROM a FULL JOIN b ON a.target = b.target""")
def compare_schemes(t):
    p = _pred(t).drop("target").withColumnRenamed("fold", "target")
    out = link.compare_full(score.score(p.where("model <> 'N'"), ["target"]), score.score(p.where("model = 'N' AND target > 0"), ["target"]), ["target"], ["R2"])
    return _r(out, "R2_before", "R2_after", "R2_delta")


@query("mean_scores", f"WITH {_PRED}, s AS (SELECT yr, target, model, {_R2} AS r2 FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT target, model, round(avg(r2), 6) AS mean_R2 FROM s GROUP BY 1, 2")
def mean_scores(t):
    return _r(score.mean_scores(score.score(_pred(t), ["yr", "target", "model"]), ["target", "model"]), "mean_R2")


@query("clip_flags", f"WITH {_PRED}, s AS (SELECT l_partkey, {_R2} AS r2 FROM p GROUP BY 1 HAVING count(*) >= 3) SELECT l_partkey, round(greatest(r2, -2.0), 5) AS drawn, r2 < -2.0 AS clipped FROM s")
def clip_flags(t):
    return _r(score.clip_flag(score.score(_pred(t), ["l_partkey"])).select("l_partkey", "drawn", "clipped"), "drawn", d=5)


@query("scheme_time_ratio", """SELECT round(s, 4) AS slow_s, round(f, 4) AS fast_s, round(s / f, 6) AS ratio FROM
(SELECT max(value) FILTER (event_type = 'purchase') AS s, max(value) FILTER (event_type = 'signup') AS f FROM events)""")
def scheme_time_ratio(t):
    e = t.events.select(F.col("event_type").alias("scheme"), F.col("value").alias("seconds"))
    out = score.scheme_ratio(e, "purchase", "signup")
    return out.select(F.round("slow_s", 4).alias("slow_s"), F.round("fast_s", 4).alias("fast_s"), F.round("ratio", 6).alias("ratio"))


@query("label_counts", """SELECT 'a' AS target, count(*) FILTER (l_discount > 0) AS n_labels FROM lineitem UNION ALL SELECT 'b', count(*) FILTER (l_tax > 0.01) FROM lineitem""")
def label_counts(t):
    li = t.lineitem.select(F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("b"))
    return score.label_counts(li, ["a", "b"])


@query("label_ranges", """
SELECT 'a' AS target, count(a) AS n, min(a) AS lo, max(a) AS hi, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd FROM (SELECT CASE WHEN l_discount > 0 THEN l_extendedprice END AS a FROM lineitem)
UNION ALL SELECT 'b', count(b), min(b), max(b), round(avg(b), 6), round(stddev_pop(b), 6) FROM (SELECT CASE WHEN l_tax > 0.01 THEN l_quantity END AS b FROM lineitem)""")
def label_ranges(t):
    li = t.lineitem.select(F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("a"), F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("b"))
    return _r(score.label_ranges(li, ["a", "b"]), "mean", "sd")


@query("tidy_predictions", """
SELECT model, family, count(*) AS n, count(VF) AS n_vf FROM (
 SELECT 'RF' AS model, n_regionkey AS family, l_discount AS VF FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'A'
 UNION ALL SELECT 'net', n_regionkey, s_acctbal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R')
WHERE VF IS NOT NULL GROUP BY 1, 2""")
def tidy_predictions(t):
    key = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("Run"), F.col("s_acctbal").alias("VF"), F.col("n_regionkey").alias("family"))
    base = t.lineitem.select(F.col("l_suppkey").alias("Run"), F.col("l_linestatus").alias("target"), F.col("l_extendedprice").alias("y_true"), F.col("l_quantity").alias("y_pred"), "l_returnflag", F.col("l_discount").alias("VF"))
    rf = base.where("l_returnflag = 'A'").withColumn("model", F.lit("RF")).drop("l_returnflag")
    net = base.where("l_returnflag = 'R'").drop("l_returnflag", "VF")
    out = score.tidy([(None, rf), ("net", net)], key)
    return out.groupBy("model", "family").agg(F.count(F.lit(1)).alias("n"), F.count("VF").alias("n_vf"))


@query("family_filter", """
SELECT kept, dropped, n FROM (SELECT count(*) FILTER (lower(c_mktsegment) = 'building') AS kept, count(*) FILTER (lower(c_mktsegment) <> 'building') AS dropped FROM customer),
(SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building')""")
def family_filter(t):
    n = gates.family_filter(t.customer, "Building", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).scalar()
    return gates.family_filter_report(t.customer, "Building", "c_mktsegment").withColumn("n", n)


@query("weighted_means", """
SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 8) AS area_mean,
 round(abs(sum((l_discount - 0.05) * l_quantity)) / sum(abs(l_discount - 0.05) * l_quantity), 6) AS cancellation FROM lineitem GROUP BY 1""")
def weighted_means(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(score.weighted_mean("l_discount", "l_quantity"), 8).alias("area_mean"),
                                                   F.round(score.cancellation(F.col("l_discount") - 0.05, "l_quantity"), 6).alias("cancellation"))
