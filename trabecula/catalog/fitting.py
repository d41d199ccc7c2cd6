"""Scaling-law queries: price against quantity stands for stiffness against density."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions.core import null_safe_join
from trabecula.functions import gates
from trabecula.operators import fit, stress
from trabecula.session import written


def _fit_sql(keys, x, y, src):
    k = ", ".join(keys)
    on = " AND ".join(f"p.{c} = f.{c}" for c in keys) or "true"
    sel = "".join(f"p.{c}, " for c in keys)
    g = f"GROUP BY {k}" if keys else ""
    return f"""pts AS (SELECT {k + ', ' if keys else ''}CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} > 0 AND {y} > 0),
fits AS (SELECT {k + ', ' if keys else ''}count(*) AS n_points, regr_slope(ln(y), ln(x)) AS ex, exp(regr_intercept(ln(y), ln(x))) AS co FROM pts {g}),
laws AS (SELECT {sel}n_points, co, ex, CASE WHEN max(y) > min(y) THEN 1 - sum((y - co * pow(x, ex)) * (y - co * pow(x, ex))) / (var_pop(y) * count(y)) ELSE 0 END AS r2
 FROM pts p JOIN fits f ON {on} WHERE n_points >= 3 AND ex IS NOT NULL GROUP BY {sel}n_points, co, ex)"""


def _rounded(df, d=6):
    return df.withColumns({"coefficient": F.round("coefficient", 3), "exponent": F.round("exponent", d), "r2": F.round("r2", d)})


@query("power_fit", "WITH " + _fit_sql(["l_returnflag"], "l_quantity", "l_extendedprice", "lineitem") + " SELECT l_returnflag, n_points, round(co, 3) AS coefficient, round(ex, 6) AS exponent, round(r2, 6) AS r2 FROM laws")
def power_fit(t):
    return _rounded(fit.power_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("power_fit_whole", "WITH " + _fit_sql([], "l_quantity", "l_extendedprice", "lineitem") + " SELECT n_points, round(co, 3) AS coefficient, round(ex, 6) AS exponent, round(r2, 6) AS r2 FROM laws")
def power_fit_whole(t):
    return _rounded(fit.power_fit(t.lineitem, "l_quantity", "l_extendedprice"))


@query("power_fit_per_part", "WITH " + _fit_sql(["l_partkey"], "l_quantity", "l_extendedprice", "lineitem") + " SELECT l_partkey, n_points, round(ex, 4) AS exponent FROM laws")
def power_fit_per_part(t):
    return fit.power_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_partkey"]).select("l_partkey", "n_points", F.round("exponent", 4).alias("exponent"))


@query("property_fits", "WITH u AS (SELECT l_returnflag, l_quantity, 'l_discount' AS property, l_discount AS v FROM lineitem UNION ALL SELECT l_returnflag, l_quantity, 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT l_returnflag, l_quantity, 'l_tax', l_tax FROM lineitem), "
       + _fit_sql(["l_returnflag", "property"], "l_quantity", "v", "u") + " SELECT l_returnflag, property, n_points, round(co, 3) AS coefficient, round(ex, 6) AS exponent, round(r2, 6) AS r2 FROM laws")
def property_fits(t):
    return _rounded(fit.property_fits(t.lineitem, "l_quantity", ["l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"]))


@query("fit_curves", "WITH " + _fit_sql(["l_returnflag"], "l_quantity", "l_extendedprice", "lineitem") + " SELECT l_returnflag, CAST(i AS INTEGER) AS point, round(0.03 + i * (0.6 - 0.03) / 57, 6) AS x, round(co * pow(0.03 + i * (0.6 - 0.03) / 57, ex), 3) AS y_fit FROM laws, range(58) g(i)")
def fit_curves(t):
    laws = fit.power_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.fit_curves(laws, 0.03, 0.6).select("l_returnflag", "point", F.round("x", 6).alias("x"), F.round("y_fit", 3).alias("y_fit"))


@query("line_fit", """WITH f AS (SELECT l_returnflag, count(*) AS n_points, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, n_points, round(s, 4) AS slope, round(i, 3) AS intercept, round(max(abs(s * l_quantity + i - l_extendedprice)), 3) AS worst_residual FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag GROUP BY 1, 2, s, i""")
def line_fit(t):
    out = fit.line_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n_points", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("worst_residual", 3).alias("worst_residual"))


_SL = {"Seed": {"l_discount": 0.05, "l_tax": 0.02}, "Size_Multi": {"l_discount": 0.05, "l_quantity": 20.0}, "Inner_Size": {"l_quantity": 20.0, "l_linenumber": 3}}


def _master(t):
    return t.lineitem.select("l_discount", "l_tax", "l_quantity", "l_linenumber", F.col("l_linenumber").alias("Seed"), F.col("l_tax").alias("Size_Multi"), F.col("l_discount").alias("Inner_Size"),
                             (F.col("l_extendedprice") / 1000).alias("E"), (F.col("l_quantity") / 51).alias("rho"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"))


@query("parameter_effects", """WITH m AS (SELECT *, l_extendedprice / 1000 AS E, l_quantity / 51 AS rho FROM lineitem),
s AS (SELECT 'Seed' AS parameter, l_linenumber * 1.0 AS v, E, rho, l_orderkey, l_linenumber, l_extendedprice FROM m WHERE l_discount = 0.05 AND l_tax = 0.02
 UNION ALL SELECT 'Size_Multi', l_tax, E, rho, l_orderkey, l_linenumber, l_extendedprice FROM m WHERE l_discount = 0.05 AND l_quantity = 20
 UNION ALL SELECT 'Inner_Size', l_discount, E, rho, l_orderkey, l_linenumber, l_extendedprice FROM m WHERE l_quantity = 20 AND l_linenumber = 3),
o AS (SELECT parameter, v, arg_min(E, (l_orderkey, l_linenumber, l_extendedprice)) AS E, arg_min(rho, (l_orderkey, l_linenumber, l_extendedprice)) AS rho FROM s GROUP BY 1, 2)
SELECT parameter, count(*) AS n, round(min(v), 4) AS lowest, round(max(v), 4) AS highest, round(max(E) / min(E), 6) AS fold,
 round(max(E / 200.0 / pow(rho, 1.83)) / min(E / 200.0 / pow(rho, 1.83)), 6) AS residual,
 CASE parameter WHEN 'Seed' THEN 'INERT' WHEN 'Size_Multi' THEN 'WEAK' WHEN 'Inner_Size' THEN 'STRUCTURAL' ELSE 'DENSITY-driving' END AS verdict FROM o GROUP BY 1""")
def parameter_effects(t):
    out = fit.slice_effects(_master(t), _SL, "E", "rho", 200.0, 1.83, "seq")
    out = fit.by_fold_change(out)
    return out.withColumns({"lowest": F.round("lowest", 4), "highest": F.round("highest", 4), "fold": F.round("fold", 6), "residual": F.round("residual", 6)})


@query("size_convergence", "WITH " + _fit_sql([], "l_quantity", "l_extendedprice", "lineitem") + " SELECT l_orderkey, l_linenumber, l_partkey, round(co * pow(l_quantity, ex) * 1.0, 3) AS predicted, round(l_extendedprice / (co * pow(l_quantity, ex)), 6) AS ratio FROM lineitem, laws WHERE l_discount = 0.05 AND l_tax = 0.02")
def size_convergence(t):
    law = fit.power_fit(t.lineitem, "l_quantity", "l_extendedprice")
    rows = t.lineitem.where(gates.on_slice({"l_discount": 0.05, "l_tax": 0.02}))
    out = fit.convergence(rows, law, "l_linenumber", "l_extendedprice", "l_quantity", 1.0, ["l_orderkey", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("predicted", 3).alias("predicted"), F.round("ratio", 6).alias("ratio"))


@query("standard_family_fit", """WITH m AS (SELECT * FROM (SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_type = 'PROMO' THEN 'flow' ELSE 'df' END AS variant, 1.6 + (p_partkey % 3) * 0.006 AS Size_Multi, 15.0 - p_partkey % 2 AS Inner_Size FROM part)
 WHERE Inner_Size = 15 AND abs(Size_Multi - 1.6) < 0.01 AND variant = 'df'), """ + _fit_sql([], "p_size", "p_retailprice", "m") + " SELECT n_points, round(co, 3) AS coefficient, round(ex, 6) AS exponent, round(r2, 6) AS r2 FROM laws")
def standard_family_fit(t):
    p = t.part.withColumns({"variant": F.when(F.col("p_type") == "PROMO", "flow").otherwise("df"), "Size_Multi": F.lit(1.6) + F.col("p_partkey") % 3 * 0.006, "Inner_Size": F.lit(15.0) - F.col("p_partkey") % 2})
    return _rounded(fit.power_fit(p.where(gates.standard_family("df")), "p_size", "p_retailprice"))


@query("chart_series", "SELECT l_linenumber AS param, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity > 10 AND l_extendedprice IS NOT NULL")
def chart_series(t):
    li = t.lineitem.withColumn("q", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))
    return fit.series(li, "l_linenumber", "q", "l_extendedprice")


@query("control_predictions", """WITH p AS (SELECT l_returnflag AS target, l_orderkey % 5 AS fold, l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice AS y FROM lineitem),
f AS (SELECT t.target, t.fold, regr_slope(ln(p.y), ln(p.x)) AS s, regr_intercept(ln(p.y), ln(p.x)) AS i FROM (SELECT DISTINCT target, fold FROM p) t JOIN p ON p.target = t.target AND p.fold <> t.fold GROUP BY 1, 2)
SELECT p.target, p.fold, l_orderkey, l_linenumber, l_partkey, y AS y_true, round(exp(i) * pow(x, s), 2) AS y_pred FROM p JOIN f ON p.target = f.target AND p.fold = f.fold""")
def control_predictions(t):
    li = t.lineitem.withColumns({"target": F.col("l_returnflag"), "fold": F.col("l_orderkey") % 5})
    out = fit.control_predictions(li, "l_quantity", "l_extendedprice", "fold", ["target"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.withColumn("y_pred", F.round("y_pred", 2))


@query("stress_summary", "SELECT event_type AS run, round(max(value * 1e-6), 10) AS max_mpa, round(quantile_cont(value * 1e-6, 0.99), 10) AS p99_mpa, count(value) AS n_nodes FROM events GROUP BY 1")
def stress_summary(t):
    e = t.events.select(F.col("event_type").alias("run"), "value")
    out = stress.stress_summary(e, ["run"])
    return out.withColumns({"max_mpa": F.round("max_mpa", 10), "p99_mpa": F.round("p99_mpa", 10)})


@query("stress_sketches", """SELECT event_type AS batch, count(value) AS n_nodes, round(max(value), 6) AS max_mpa, true AS p50_within, true AS p99_within FROM events GROUP BY 1""")
def stress_sketches(t):
    """One sketch per run (user), stored and merged per batch (event type): the quantiles' true ranks are within the stated error."""
    runs = written(stress.stress_sketches(t.events, ["user_id", "event_type"], unit=1.0)).withColumnRenamed("event_type", "batch")
    got = written(stress.sketched_quantiles(runs, ["batch"], [0.5, 0.99], ["p50", "p99"]))
    rows = null_safe_join(t.events.where("value IS NOT NULL").select(F.col("event_type").alias("batch"), "value"), got, ["batch"])
    def within(c, p):  # values may repeat: the rank of a quantile is a range
        below, upto = F.avg((F.col("value") < F.col(c)).cast("double")), F.avg((F.col("value") <= F.col(c)).cast("double"))
        return ((below <= p + F.max("rank_error")) & (upto >= p - F.max("rank_error"))).alias(f"{c}_within")
    return rows.groupBy("batch").agg(F.max("n_nodes").alias("n_nodes"), F.round(F.max("max_mpa"), 6).alias("max_mpa"), within("p50", 0.5), within("p99", 0.99))


@query("quartile_spread", "SELECT user_id, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1")
def quartile_spread(t):
    out = stress.quartile_spread(t.events, ["user_id"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "q3", "iqr")})


@query("yield_onset", """WITH s AS (SELECT user_id, max(value) AS mx, quantile_cont(value, 0.99) AS p99, count(value) AS n FROM events GROUP BY 1),
m AS (SELECT c_custkey AS user_id, abs(c_acctbal) / 1000 AS e FROM customer)
SELECT s.user_id, n AS n_nodes, round(p99, 6) AS p99_mpa, round(mx, 6) AS max_mpa, round(e * 1000.0 * 0.01, 6) AS applied_mpa, round(e * 1000.0 * 0.01 * 250.0 / p99, 5) AS onset_mpa, round(p99 / (e * 1000.0 * 0.01), 6) AS scf FROM s JOIN m USING (user_id)""")
def yield_onset(t):
    s = stress.stress_summary(t.events, ["user_id"], unit=1.0)
    m = t.customer.select(F.col("c_custkey").alias("user_id"), (F.abs("c_acctbal") / 1000).alias("e"))
    out = stress.yield_onset(s, m, ["user_id"], "e", 250.0, 0.01)
    return out.withColumns({"p99_mpa": F.round("p99_mpa", 6), "max_mpa": F.round("max_mpa", 6), "applied_mpa": F.round("applied_mpa", 6), "onset_mpa": F.round("onset_mpa", 5), "scf": F.round("scf", 6)})
