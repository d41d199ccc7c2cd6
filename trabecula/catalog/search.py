"""Inverse-search queries: customers and suppliers stand for two families of designs, balance for the property."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions import gates
from trabecula.functions.tensor import unit_sanity as sane
from trabecula.operators import search
from trabecula.operators.ordered import running_total
from trabecula.plans import inverse_search

TARGET = 5000.0
_FAM = """fam AS (SELECT 'aperiodic' AS family, c_name AS Run, c_custkey AS k, c_acctbal AS v, c_nationkey AS nat FROM customer
 UNION ALL SELECT 'periodic', s_name, s_suppkey, s_acctbal, s_nationkey FROM supplier)"""


def _families(t):
    a = t.customer.select(F.lit("aperiodic").alias("family"), F.col("c_name").alias("Run"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("nat"))
    b = t.supplier.select(F.lit("periodic").alias("family"), F.col("s_name").alias("Run"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("nat"))
    return a.unionByName(b)


_OV = "g AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT family, min(v) AS lo, max(v) AS hi FROM fam GROUP BY 1))"


@query("domain_overlap", f"WITH {_FAM}, {_OV} SELECT count(*) AS n_rows, count(*) FILTER (v BETWEEN lo AND hi) AS n_inside, any_value(lo) AS lo, any_value(hi) AS hi, coalesce(any_value(lo) < any_value(hi) AND any_value(lo) <= 5000 AND any_value(hi) >= 5000, false) AS gate1 FROM fam, g")
def domain_overlap(t):
    return search.domain_overlap(_families(t), "family", "v", TARGET)


@query("target_nearest_per_family", f"""WITH {_FAM}, {_OV}, r AS (SELECT fam.*, abs(v - 5000) AS abs_err, v BETWEEN lo AND hi AS ok, lo, hi FROM fam, g),
b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY abs_err, Run) AS rn FROM r)
SELECT family, Run, k, v, round(abs_err, 4) AS abs_err, ok AS gate4_ok, lo < hi AND lo <= 5000 AND hi >= 5000 AS gate1, lo AS overlap_lo, hi AS overlap_hi FROM b WHERE rn = 1""")
def target_nearest_per_family(t):
    out = inverse_search.target_answer(_families(t), "family", "v", TARGET, "Run")
    return out.withColumn("abs_err", F.round("abs_err", 4)).drop("nat")


@query("range_guard", f"WITH {_FAM} SELECT family, k, v BETWEEN 100 AND 9000 AS gate4_ok FROM fam")
def range_guard(t):
    return search.rank_by_distance(_families(t), "v", TARGET, F.lit(100.0), F.lit(9000.0)).select("family", "k", "gate4_ok")


@query("closest_designs", f"WITH {_FAM} SELECT family, Run, round(abs(v - 5000), 4) AS abs_err FROM fam WHERE v BETWEEN 100 AND 9000 ORDER BY abs(v - 5000), Run LIMIT 10")
def closest_designs(t):
    r = search.rank_by_distance(_families(t), "v", TARGET, F.lit(100.0), F.lit(9000.0)).where("gate4_ok")
    return search.closest(r, 10).select("family", "Run", F.round("abs_err", 4).alias("abs_err"))


@query("winners_by_topology", f"WITH {_FAM} SELECT family, nat, arg_min(Run, (abs(v - 5000), Run)) AS Run FROM fam GROUP BY 1, 2")
def winners_by_topology(t):
    r = search.rank_by_distance(_families(t), "v", TARGET, F.lit(100.0), F.lit(9000.0))
    return search.winners(r, ["family", "nat"]).select("family", "nat", "Run")


_TIE = f"""WITH {_FAM}, c AS (SELECT *, abs(v - 5000) / 5000 * 100 AS off_pct, abs(v - 5000) / 5000 * 100 <= 6.6 AS in_band, CASE WHEN k % 9 <> 0 THEN (k * 7919 % 1009) / 1009.0 END AS tai FROM fam),
o AS (SELECT *, CASE WHEN in_band THEN 0 ELSE 1 END AS g, CASE WHEN in_band THEN tai ELSE off_pct END AS kk FROM c)"""


def _cands(t):
    return _families(t).withColumn("tai", F.when(F.col("k") % 9 != 0, F.col("k") * 7919 % 1009 / 1009.0))


@query("tie_band_ranking", _TIE + " SELECT row_number() OVER (ORDER BY g, kk NULLS LAST, Run) AS rank, Run, in_band, round(off_pct, 4) AS off_pct FROM o")
def tie_band_ranking(t):
    out = search.rank_candidates(_cands(t), "v", TARGET, "tai", tie="Run")
    return out.select("rank", "Run", "in_band", F.round("off_pct", 4).alias("off_pct"))


@query("tie_band_ranking_max", _TIE.replace("THEN tai ELSE off_pct", "THEN -tai ELSE off_pct") + " SELECT family, row_number() OVER (PARTITION BY family ORDER BY g, kk NULLS LAST, Run) AS rank, Run FROM o")
def tie_band_ranking_max(t):
    return search.rank_candidates(_cands(t), "v", TARGET, "tai", goal="max", keys=["family"], tie="Run").select("family", "rank", "Run")


@query("top_candidates", _TIE + " SELECT Run, in_band FROM o ORDER BY g, kk NULLS LAST, Run LIMIT 5")
def top_candidates(t):
    return search.top_candidates(_cands(t), 5, "v", TARGET, "tai", tie="Run").select("Run", "in_band")


_FIN = _TIE + ", fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY g, kk NULLS LAST, Run) AS rn FROM o) WHERE rn = 1)"


@query("finalists", _FIN + " SELECT family, Run, round(off_pct, 4) AS off_pct FROM fin")
def finalists(t):
    out = search.finalists(_cands(t), "family", "v", TARGET, "tai", tie="Run")
    return out.select("family", "Run", F.round("off_pct", 4).alias("off_pct"))


@query("trade_off", _FIN + """ SELECT max(v) FILTER (family = 'aperiodic') AS v_a, max(v) FILTER (family = 'periodic') AS v_b, max(k) FILTER (family = 'aperiodic') AS k_a, max(k) FILTER (family = 'periodic') AS k_b,
 round((max(v) FILTER (family = 'aperiodic') - max(v) FILTER (family = 'periodic')) / max(v) FILTER (family = 'periodic') * 100, 5) AS v_diff_pct,
 round((max(k) FILTER (family = 'aperiodic') - max(k) FILTER (family = 'periodic')) / max(k) FILTER (family = 'periodic') * 100, 5) AS k_diff_pct FROM fin""")
def trade_off(t):
    fin = search.finalists(_cands(t), "family", "v", TARGET, "tai", tie="Run")
    out = search.trade_off(fin, "family", "aperiodic", "periodic", ["v", "k"])
    return out.withColumns({"v_diff_pct": F.round("v_diff_pct", 5), "k_diff_pct": F.round("k_diff_pct", 5)})


@query("context_rows", f"WITH {_FAM} SELECT Run, round(abs(v - 5000) / 50, 4) AS off_pct, 'EXISTING' AS source, false AS eligible FROM fam ORDER BY abs(v - 5000), Run LIMIT 20")
def context_rows(t):
    return search.context_rows(_families(t), "v", TARGET).select("Run", F.round("off_pct", 4).alias("off_pct"), "source", "eligible")


@query("mesh_gate", """WITH m AS (SELECT p_partkey, p_partkey % 5 <> 0 AS w, p_partkey % 7 <> 0 AS d, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END AS b, p_size % 4 AS e FROM part)
SELECT p_partkey, w AND d AND b = 1 AND e % 2 = 0 AS ok, concat_ws('; ', CASE WHEN e % 2 <> 0 THEN 'V - E + F = ' || e || ' is odd' END, CASE WHEN b <> 1 THEN b || ' parts instead of one' END, CASE WHEN NOT w THEN 'surface has open edges' END, CASE WHEN NOT d THEN 'faces turn both ways' END) AS detail FROM m""")
def mesh_gate(t):
    k = F.col("p_partkey")
    m = t.part.select("p_partkey", (k % 5 != 0).alias("watertight"), (k % 7 != 0).alias("winding_ok"), F.when(k % 11 == 0, 2).otherwise(1).alias("bodies"), (F.col("p_size") % 4).alias("euler"))
    return m.withColumn("g", gates.mesh_gate()).select("p_partkey", "g.ok", "g.detail")


@query("generation_gate", """WITH m AS (SELECT p_partkey, p_retailprice / 950 AS vf, CASE WHEN p_partkey % 3 <> 0 THEN 1 + p_size * 0.001 END AS asked FROM part)
SELECT p_partkey, abs((vf - asked) / asked) <= 0.03 AS gate3, round((vf - asked) / asked, 8) AS gate3_err, (p_size > 10) AND coalesce(abs((vf - asked) / asked) <= 0.03, true) AS eligible FROM m JOIN part USING (p_partkey)""")
def generation_gate(t):
    m = t.part.select("p_partkey", (F.col("p_retailprice") / 950).alias("vf"), F.when(F.col("p_partkey") % 3 != 0, 1 + F.col("p_size") * 0.001).alias("asked"), (F.col("p_size") > 10).alias("gate2"), F.lit(True).alias("gate4"))
    m = m.withColumn("g", gates.generation_gate("vf", "asked", 0.03)).withColumns({"gate3": F.col("g.ok"), "gate3_err": F.round("g.err", 8)})
    return m.select("p_partkey", "gate3", "gate3_err", gates.eligible().alias("eligible"))


@query("unit_sanity", """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / CASE l_linenumber WHEN 1 THEN 100.0 WHEN 2 THEN 1000.0 ELSE 100000.0 END * CASE WHEN l_orderkey % 17 = 0 THEN -1 ELSE 1 END AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, e > 0 AND e < 1 AS ok, CASE WHEN NOT (e > 0 AND e < 1) THEN pow(10, round_even(log10(abs(e)), 0)) END AS factor FROM e""")
def unit_sanity(t):
    n = F.col("l_linenumber")
    e = F.col("l_extendedprice") / F.when(n == 1, 100.0).when(n == 2, 1000.0).otherwise(100000.0) * F.when(F.col("l_orderkey") % 17 == 0, -1).otherwise(1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sane(e).alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.ok", "s.factor")


@query("final_gate", """WITH f AS (SELECT s_suppkey, n.name AS target, n.p AS predicted, n.m AS measured FROM supplier, LATERAL (VALUES ('E_over_Es', s_acctbal, s_acctbal * (0.8 + (s_suppkey % 5) * 0.1)), ('TAI', s_suppkey * 1.0, s_suppkey * 1.0 - 3)) n(name, p, m))
SELECT s_suppkey, target, round(predicted, 4) AS predicted, round(measured, 4) AS measured, round((predicted - measured) / nullif(measured, 0) * 100, 5) AS diff_pct, coalesce(abs((predicted - measured) / nullif(measured, 0) * 100) <= 15, false) AS ok FROM f""")
def final_gate(t):
    p = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("pred_E_over_Es"), F.col("s_suppkey").alias("pred_TAI"))
    m = t.supplier.select("s_suppkey", (F.col("s_acctbal") * (F.lit(0.8) + F.col("s_suppkey") % 5 * 0.1)).alias("E_over_Es"), (F.col("s_suppkey") - 3.0).alias("TAI"))
    out = inverse_search.verify(p, m, ["s_suppkey"], ["E_over_Es", "TAI"])
    return out.withColumns({"predicted": F.round("predicted", 4), "measured": F.round("measured", 4), "diff_pct": F.round("diff_pct", 5)})


@query("monotone_curves", """WITH s AS (SELECT o_custkey, o_totalprice <= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bad FROM orders)
SELECT o_custkey, count(*) FILTER (bad) AS n_bad_steps, count(*) FILTER (bad) = 0 AS monotone FROM s GROUP BY 1 HAVING count(bad) > 0""")
def monotone_curves(t):
    return search.is_monotone(t.orders, ["o_custkey"], "o_orderkey", "o_totalprice")


@query("calibration_acceptance", """WITH c AS (SELECT o_custkey AS topo, o_orderkey AS t, o_totalprice AS vf, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 5 = 0 THEN 'other' ELSE 'abc' END AS h, CASE WHEN o_custkey % 6 = 0 THEN 0.1 ELSE 0.05 END AS tol FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT *, vf <= lag(vf) OVER (PARTITION BY topo ORDER BY t) AS bad FROM c)
SELECT topo, count(*) AS n_points, count(*) FILTER (h <> 'abc') AS n_other_source, count(*) FILTER (tol <> 0.05) AS n_other_tolerance, count(*) >= 3 AND count(*) FILTER (h <> 'abc') = 0 AND count(*) FILTER (tol <> 0.05) = 0 AND count(*) FILTER (bad) = 0 AS accepted FROM s GROUP BY 1""")
def calibration_acceptance(t):
    k = F.col("o_custkey")
    c = t.orders.select(k.alias("topo"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("vf"), (F.col("o_orderstatus") != "P").alias("ok"),
                        F.when((k % 4 == 0) & (F.col("o_orderkey") % 5 == 0), "other").otherwise("abc").alias("source_sha1"), F.when(k % 6 == 0, 0.1).otherwise(0.05).alias("tolerance_mm"))
    return search.calibration_check(c, ["topo"], "abc", 0.05).select("topo", "n_points", "n_other_source", "n_other_tolerance", "accepted")


@query("ensemble_mean", """WITH s(target, mean, sd, use_log) AS (VALUES ('A', 0.5, 0.2, true), ('R', 10.0, 3.0, false))
SELECT l_partkey, l_returnflag AS target, round(CASE WHEN use_log THEN pow(10, avg(l_discount) * sd + mean) ELSE avg(l_discount) * sd + mean END, 6) AS predicted FROM lineitem JOIN s ON l_returnflag = target GROUP BY 1, 2, use_log, sd, mean""")
def ensemble_mean(t):
    pred = t.lineitem.select("l_partkey", F.col("l_returnflag").alias("target"), F.col("l_discount").alias("z"))
    stats = t.spark.createDataFrame([("A", 0.5, 0.2, True), ("R", 10.0, 3.0, False)], "target string, mean double, sd double, use_log boolean")
    return search.ensemble(pred, stats, ["l_partkey"]).withColumn("predicted", F.round("predicted", 6))


@query("replay_check", """WITH e AS (SELECT p_partkey, p_retailprice AS a, p_size * 1.0 AS b, p_retailprice * (1 + (p_partkey % 5) * 0.004) AS a2, CASE WHEN p_partkey % 13 <> 0 THEN p_size * (1 - (p_partkey % 3) * 0.003) END AS b2 FROM part)
SELECT p_partkey, round(greatest(abs((a2 - a) / a), abs((b2 - b) / b)), 8) AS max_rel_err, greatest(abs((a2 - a) / a), abs((b2 - b) / b)) <= 0.01 AS gate0 FROM e""")
def replay_check(t):
    k = F.col("p_partkey")
    e = t.part.select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    a = t.part.select("p_partkey", (F.col("p_retailprice") * (1 + k % 5 * 0.004)).alias("a"), F.when(k % 13 != 0, F.col("p_size") * (1 - k % 3 * 0.003)).alias("b"))
    return search.replay_check(e, a, ["p_partkey"], ["a", "b"]).withColumn("max_rel_err", F.round("max_rel_err", 8))


@query("rebuild_check", """WITH r AS (SELECT p_partkey, p_retailprice * (1 + (p_partkey % 5) * 0.006) AS vf, p_retailprice AS vf0, p_size AS euler, p_size + (p_partkey % 7 = 0)::INT AS euler0, p_partkey % 3 <> 0 AS gate2 FROM part)
SELECT p_partkey, round((vf - vf0) / vf0 * 100, 6) AS vf_diff_pct, euler = euler0 AS euler_same, abs((vf - vf0) / vf0 * 100) < 2 AND gate2 AS verified FROM r""")
def rebuild_check(t):
    k = F.col("p_partkey")
    new = t.part.select("p_partkey", (F.col("p_retailprice") * (1 + k % 5 * 0.006)).alias("vf"), F.col("p_size").alias("euler"), (k % 3 != 0).alias("gate2"))
    old = t.part.select("p_partkey", F.col("p_retailprice").alias("vf"), (F.col("p_size") + (k % 7 == 0).cast("int")).alias("euler"))
    out = search.rebuild_check(new, old, ["p_partkey"], {"vf": "vf"}, ["euler"])
    return out.select("p_partkey", F.round("vf_diff_pct", 6).alias("vf_diff_pct"), "euler_same", "verified")


@query("precondition_gate", """WITH m AS (SELECT p_partkey, p_size > 5 AS passed, p_brand AS source, p_retailprice AS tol FROM part)
SELECT p_partkey, passed AND source = 'Brand#2' AND tol = 900 AS ready, concat_ws('; ', CASE WHEN NOT passed THEN 'check failed' END, CASE WHEN source <> 'Brand#2' THEN 'different source' END, CASE WHEN tol <> 900 THEN 'different tol' END) AS reason FROM m""")
def precondition_gate(t):
    m = t.part.select("p_partkey", (F.col("p_size") > 5).alias("passed"), F.col("p_brand").alias("source"), F.col("p_retailprice").alias("tol"))
    return search.precondition(m, {"source": "Brand#2", "tol": 900.0}).select("p_partkey", "ready", "reason")


@query("batch_scoring_rows", "SELECT p_partkey, p_size > 3 AS ok, CASE WHEN p_size <= 3 THEN 'size ' || p_size END AS detail FROM part")
def batch_scoring_rows(t):
    return search.batch_scores(t.part, F.col("p_size") > 3, F.concat(F.lit("size "), F.col("p_size").cast("string"))).select("p_partkey", "ok", "detail")


@query("density_plan", """WITH c AS (SELECT n_regionkey AS topo, s_suppkey * 1.0 AS t, sum(2.5 + s_suppkey % 5) OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS vf FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT topo, min(vf) AS lo, max(vf) AS hi FROM c GROUP BY 1),
k AS (SELECT n_nationkey AS id, n_regionkey AS topo, 20.0 + n_nationkey AS rho FROM nation),
s AS (SELECT id, topo, greatest(lo, rho - 4) AS a, least(hi, rho + 4) AS b FROM k JOIN e USING (topo)),
n AS (SELECT *, greatest(2, CAST(round_even((b - a) / 0.5, 0) + 1 AS INT)) AS n FROM s WHERE b >= a),
p AS (SELECT DISTINCT topo, round(a + (b - a) * i / (n - 1), 4) AS rho FROM n, range(200) g(i) WHERE i < n),
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.topo = p.topo AND abs(k.rho - p.rho) <= 0.25)),
iv AS (SELECT topo, t AS t0, lead(t) OVER w AS t1, vf AS v0, lead(vf) OVER w AS v1 FROM c WINDOW w AS (PARTITION BY topo ORDER BY vf))
SELECT f.topo, f.rho, round(max(t0 + (f.rho - v0) / (v1 - v0) * (t1 - t0)), 4) AS t_solved FROM f JOIN iv ON f.topo = iv.topo AND f.rho >= v0 AND f.rho <= v1 GROUP BY 1, 2""")
def density_plan(t):
    reg = F.col("n_regionkey").alias("topo")
    c = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(reg, "s_suppkey", F.col("s_suppkey").cast("double").alias("t"), (F.lit(2.5) + F.col("s_suppkey") % 5).alias("step"))
    curve = running_total(c, ["topo"], ["s_suppkey"], F.floor(F.col("s_suppkey") / 4096), "step", out="vf").select("topo", "t", "vf")
    centres = t.nation.select(reg, F.col("n_nationkey").alias("id"), (F.lit(20.0) + F.col("n_nationkey")).alias("rho"))
    out = inverse_search.density_plan(centres.join(curve.select("topo").distinct(), "topo"), curve, centres, 4.0, 0.5, ["topo"])
    return out.where("in_range").select("topo", "rho", F.round("t_solved", 4).alias("t_solved"))
