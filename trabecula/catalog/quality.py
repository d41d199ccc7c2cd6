"""Quality-gate queries: price, discount and tax ratios stand for measured and stated quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions import gates, tensor
from trabecula.functions.core import number
from trabecula.operators import quality


def _dataset(t):
    """Line items as a feature table with every check's columns."""
    k = F.col("l_orderkey")
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("Run"), "l_returnflag", "l_extendedprice", "l_quantity",
        (F.col("l_quantity") / 51).alias("VF"), (F.col("l_quantity") / 51 * (1 + (F.col("l_discount") - 0.05))).alias("Rho_rel"),
        (F.col("l_partkey") % 3000).alias("n_tris"), F.when(k % 50 == 0, 0).otherwise(1).alias("watertight"),
        F.when(k % 97 == 0, 0).otherwise(1).alias("winding_ok"), F.when(k % 13 != 0, F.col("l_tax")).alias("tax"),
        (F.col("l_discount") * 12).alias("E_over_Es"), (F.col("l_tax") * 7 - 0.1).alias("nu_iso"), (F.col("l_discount") * 25).alias("TAI"),
        (F.col("l_tax") * 60).alias("C11_n"))


_D = """d AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS Run, l_returnflag, l_extendedprice, l_quantity, l_quantity / 51 AS VF,
 l_quantity / 51 * (1 + (l_discount - 0.05)) AS Rho_rel, l_partkey % 3000 AS n_tris, CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE 1 END AS watertight,
 CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE 1 END AS winding_ok, CASE WHEN l_orderkey % 13 <> 0 THEN l_tax END AS tax,
 l_discount * 12 AS E_over_Es, l_tax * 7 - 0.1 AS nu_iso, l_discount * 25 AS TAI, l_tax * 60 AS C11_n FROM lineitem)"""


@query("density_agreement", f"""WITH {_D}, r AS (SELECT l_returnflag, VF / Rho_rel AS r FROM d)
SELECT l_returnflag, count(r) AS n, count(*) FILTER (abs(r - 1) < 0.035) AS n_agree, round(avg(r), 6) AS mean_ratio, round(min(r), 6) AS min_ratio, round(max(r), 6) AS max_ratio,
 round(count(*) FILTER (abs(r - 1) < 0.035) / count(r), 6) AS share, CASE WHEN count(*) FILTER (abs(r - 1) < 0.035) / count(r) >= 0.9 THEN 'ok' ELSE 'fail' END AS verdict FROM r GROUP BY 1""")
def density_agreement(t):
    out = quality.agreement(_dataset(t), "VF", "Rho_rel", tol=0.035, keys=["l_returnflag"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ratio", "min_ratio", "max_ratio", "share")})


@query("worst_deviations", f"WITH {_D} SELECT Run, round(VF / Rho_rel, 6) AS ratio FROM d ORDER BY abs(VF / Rho_rel - 1) * (1 + (l_extendedprice * 0.000001)) DESC, Run LIMIT 5")
def worst_deviations(t):
    d = _dataset(t).withColumn("b", F.col("Rho_rel"))
    d = d.withColumn("off", F.abs(F.col("VF") / F.col("b") - 1) * (1 + F.col("l_extendedprice") * 0.000001))
    out = quality.worst_rows(d, F.col("off") + 1, F.lit(1.0))
    return out.select("Run", F.round(F.col("VF") / F.col("b"), 6).alias("ratio"))


@query("ratio_spread", f"""WITH {_D}, r AS (SELECT l_returnflag, VF / Rho_rel AS r FROM d)
SELECT l_returnflag, round(min(r), 6) AS lowest, round(max(r), 6) AS highest, round(avg(CASE WHEN r BETWEEN 0.98 AND 1.02 THEN 1.0 ELSE 0.0 END), 6) AS share_close, round(quantile_cont(r, 0.5), 6) AS median FROM r GROUP BY 1""")
def ratio_spread(t):
    d = _dataset(t).select("l_returnflag", (F.col("VF") / F.col("Rho_rel")).alias("r"))
    out = quality.ratio_spread(d, ["l_returnflag"], "r", 0.02)
    return out.withColumns({c: F.round(c, 6) for c in ("lowest", "highest", "share_close", "median")})


@query("integrity_checks", f"""WITH {_D}, c AS (SELECT count(*) FILTER (tax IS NULL) AS a, count(*) FILTER (VF <= 0 OR VF >= 1) AS b, count(*) FILTER (n_tris < 1000) AS c, count(*) FILTER (winding_ok = 0) AS e, count(*) FILTER (VF IS NULL) AS f FROM d)
SELECT u.* FROM c, LATERAL (VALUES ('null tax', 'fail', a), ('null VF', 'fail', f), ('missing column thickness', 'fail', 1::BIGINT), ('impossible VF', 'fail', b), ('coarse mesh', 'warn', c.c), ('inconsistent winding', 'fail', e)) u("check", severity, n)""")
def integrity_checks(t):
    return quality.integrity(_dataset(t), ["tax", "VF", "thickness"])


@query("leak_rule", f"""WITH {_D}, c AS (SELECT count(*) FILTER (watertight = 0 AND abs(VF / Rho_rel - 1) < 0.035) AS n_cosmetic, count(*) FILTER (watertight = 0 AND NOT abs(VF / Rho_rel - 1) < 0.035) AS n_invalid FROM d)
SELECT *, CASE WHEN n_invalid > 0 THEN 'fail' WHEN n_cosmetic > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM c""")
def leak_rule(t):
    return quality.leak_rule(_dataset(t), 0.035)


@query("physical_bands", f"""WITH {_D}, r(target, lo, hi, hard) AS (VALUES ('E_over_Es', 0.0::DOUBLE, 1.05::DOUBLE, true), ('nu_iso', -1.0, 0.5, true), ('TAI', 0.0, NULL, true), ('C11_n', 0.0, NULL, true), ('C11_n', NULL, 4.0, false), ('TAI', NULL, 2.0, false)),
v AS (SELECT 'E_over_Es' AS target, E_over_Es AS x FROM d UNION ALL SELECT 'nu_iso', nu_iso FROM d UNION ALL SELECT 'TAI', TAI FROM d UNION ALL SELECT 'C11_n', C11_n FROM d),
g AS (SELECT r.target, lo, hi, hard, count(x) AS n_values, count(*) FILTER ((lo IS NOT NULL AND x < lo) OR (hi IS NOT NULL AND x > hi)) AS n_outside FROM r JOIN v ON r.target = v.target GROUP BY 1, 2, 3, 4)
SELECT target, lo, hi, n_values, n_outside, CASE WHEN n_outside = 0 THEN 'ok' WHEN hard THEN 'fail' ELSE 'warn' END AS severity FROM g""")
def physical_bands(t):
    return quality.band_rules(_dataset(t))


@query("skew_report", """WITH s AS (SELECT 'price' AS feature, count(l_extendedprice) AS n, skewness(l_extendedprice) AS a, skewness(log10(abs(l_extendedprice) + 1e-12)) AS b FROM lineitem UNION ALL
SELECT 'heavy', count(h), skewness(h), skewness(log10(abs(h) + 1e-12)) FROM (SELECT pow(l_quantity / 10, 6) * (CASE WHEN l_linenumber = 7 THEN 50 ELSE 1 END) AS h FROM lineitem))
SELECT feature, n, round(a, 5) AS skew, round(b, 5) AS log_skew, coalesce(abs(a) > 3, false) AS flagged FROM s""")
def skew_report(t):
    li = t.lineitem.select(F.col("l_extendedprice").alias("price"), (F.pow(F.col("l_quantity") / 10, 6) * F.when(F.col("l_linenumber") == 7, 50).otherwise(1)).alias("heavy"))
    return quality.skew_report(li, ["price", "heavy"]).withColumns({"skew": F.round("skew", 5), "log_skew": F.round("log_skew", 5)})


@query("ratio_cross_checks", """WITH r AS (SELECT l_extendedprice / (l_quantity * 2000) AS a, l_tax / nullif(l_discount, 0) AS b FROM lineitem)
SELECT 'price_ratio' AS ratio_name, count(a) AS n, round(avg(a), 6) AS mean, count(*) FILTER (NOT (a > 0.9 AND a < 1.1)) AS n_outside FROM r UNION ALL
SELECT 'tax_ratio', count(b), round(avg(b), 6), count(*) FILTER (NOT (b > 0.5 AND b < 2)) FROM r UNION ALL SELECT 'absent', 0, NULL, 0""")
def ratio_cross_checks(t):
    li = t.lineitem.withColumn("ref", F.col("l_quantity") * 2000)
    out = quality.cross_checks(li, [("l_extendedprice", "ref", "price_ratio", 0.9, 1.1), ("l_tax", "l_discount", "tax_ratio", 0.5, 2.0), ("nope", "ref", "absent", 0.9, 1.1)])
    return out.withColumn("mean", F.round("mean", 6))


@query("element_order_drift", """WITH e AS (SELECT vec_id, embedding[1:36]::DOUBLE[] AS a, [x * (1 + (vec_id % 7) * 0.002) for x in embedding[1:36]::DOUBLE[]] AS b FROM embeddings),
d AS (SELECT vec_id, list_max([abs(p[1] - p[2]) / greatest(abs(p[2]), 1e-9) for p in list_zip(a, b)]) * 100 AS m, abs(a[1] - b[1]) / abs(b[1]) * 100 AS c FROM e)
SELECT vec_id, round(m, 6) AS max_term_pct, round(c, 6) AS c11_pct, CASE WHEN c < 1 THEN 'confirmed' ELSE 'stale' END AS verdict FROM d""")
def element_order_drift(t):
    a = F.slice(F.col("embedding").cast("array<double>"), 1, 36)
    e = t.embeddings.select("vec_id", a.alias("a")).withColumn("b", tensor.scale("a", 1 + F.col("vec_id") % 7 * 0.002))
    d = e.withColumn("d", tensor.drift("a", "b"))
    return d.select("vec_id", F.round("d.max_term_pct", 6).alias("max_term_pct"), F.round("d.c11_pct", 6).alias("c11_pct"), quality.drift_verdict("d.c11_pct").alias("verdict"))


@query("name_ratio_gate", """SELECT kept, count(*) AS n FROM (SELECT coalesce(l_extendedprice / (l_quantity * 2000) > 0.85 AND l_extendedprice / (l_quantity * 2000) < 1.15, true) AS kept FROM lineitem) GROUP BY 1""")
def name_ratio_gate(t):
    kept, rejected = gates.split_by(t.lineitem, gates.name_ratio_gate("l_extendedprice", F.col("l_quantity") * 2000))
    both = kept.select(F.lit(True).alias("kept")).unionByName(rejected.select(F.lit(False).alias("kept")))
    return both.groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("usable_rows", """SELECT count(*) FILTER (s LIKE 'OK%') AS n_prefix, count(*) FILTER (upper(s) = 'OK') AS n_exact FROM
(SELECT coalesce(CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'OK (no shear CSV)' WHEN l_linenumber = 3 THEN 'FAIL' WHEN l_linenumber = 4 THEN 'ok' ELSE 'OK' END, 'OK') AS s FROM lineitem)""")
def usable_rows(t):
    n = F.col("l_linenumber")
    s = F.when(n == 1, F.lit(None).cast("string")).when(n == 2, "OK (no shear CSV)").when(n == 3, "FAIL").when(n == 4, "ok").otherwise("OK")
    return t.lineitem.select(s.alias("s")).agg(F.count_if(gates.usable("s")).alias("n_prefix"), F.count_if(gates.usable("s", exact=True)).alias("n_exact"))


_HOLD = [("exact_text", "l_returnflag|R", "l_returnflag = 'R'"), ("exact_number", "l_discount|0.05", "abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05"),
         ("at_least", "l_quantity|>=45", "l_quantity >= 45"), ("below", "l_tax|<0.02", "l_tax < 0.02"), ("range", "l_discount|0.02..0.04", "l_discount BETWEEN 0.02 AND 0.04"),
         ("above", "l_quantity|>49", "l_quantity > 49"), ("at_most", "l_quantity|<=2", "l_quantity <= 2"), ("text_not_number", "l_returnflag|>=3", "false")]


@query("holdout_predicates", "SELECT name, n FROM (SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, _, c in _HOLD) + " FROM lineitem) UNPIVOT (n FOR name IN (" + ", ".join(n for n, *_ in _HOLD) + "))")
def holdout_predicates(t):
    specs = gates.parse_holdouts([f"{n}|{s}" for n, s, _ in _HOLD] + ["broken|two", "gone|no_column|3", "bad|l_quantity|>=x"])
    masks = {s.name: gates.holdout_filter(t.lineitem, s) for s in specs}
    masks = {n: m for n, m in masks.items() if m is not None}
    one = t.lineitem.agg(*[F.count_if(m).alias(n) for n, m in masks.items()])
    return one.unpivot([], list(masks), "name", "n")


@query("labelless_rows", "SELECT count(*) AS n FROM lineitem WHERE CASE WHEN l_discount > 0.05 THEN l_discount END IS NOT NULL OR CASE WHEN l_tax > 0.05 THEN l_tax END IS NOT NULL")
def labelless_rows(t):
    li = t.lineitem.select(F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("a"), F.when(F.col("l_tax") > 0.05, F.col("l_tax")).alias("b"))
    return li.where(gates.has_any("a", "b")).agg(F.count(F.lit(1)).alias("n"))


@query("excluded_topologies", "SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO') GROUP BY 1")
def excluded_topologies(t):
    return t.part.where(gates.not_excluded("p_type", ["ECONOMY", "PROMO"])).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("density_selection", """WITH r AS (SELECT p_partkey, p_size * 0.1 AS d FROM part WHERE p_size * 0.1 BETWEEN 0.7 AND 4.1), m AS (SELECT min(d) AS lo FROM r)
SELECT p_partkey FROM r, m WHERE abs((d - lo) / 0.3 - round_even((d - lo) / 0.3, 0)) < 1e-6""")
def density_selection(t):
    p = t.part.select("p_partkey", (F.col("p_size") * F.lit(0.1)).alias("d"))
    return gates.select_densities(p, "d", 0.7, 4.1, 0.3).select("p_partkey")


@query("numeric_coercion", """SELECT count(x) AS n_numbers, count(*) AS n_rows, round(sum(x), 2) AS total FROM (SELECT try_cast(trim(CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN ' ' || l_quantity || ' ' WHEN l_linenumber = 3 THEN '' ELSE CAST(l_quantity AS VARCHAR) END) AS DOUBLE) AS x FROM lineitem)""")
def numeric_coercion(t):
    n = F.col("l_linenumber")
    s = F.when(n == 1, "n/a").when(n == 2, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "))).when(n == 3, "").otherwise(F.col("l_quantity").cast("string"))
    x = number("s")
    return t.lineitem.select(s.alias("s")).agg(F.count(x).alias("n_numbers"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(x), 2).alias("total"))
