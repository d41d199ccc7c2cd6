"""Name, unit and key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.functions import names, units

_STEM = """s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '5cube_seed' ELSE 'LAT' || CASE p_partkey % 4 WHEN 0 THEN '_flow' WHEN 1 THEN ' RAW' WHEN 2 THEN 'DF' ELSE '_x' END
 || '_i' || p_size || CASE WHEN p_size % 2 = 0 THEN 'p5' ELSE '' END || '_d' || replace(CAST(p_retailprice AS VARCHAR), '.', 'p') || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_t0p' || (p_partkey % 9 + 1) END || '_s' || (p_partkey % 6) || '_m1p6' END AS stem FROM part)"""


def _stems(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, "_flow").when(k % 4 == 1, " RAW").when(k % 4 == 2, "DF").otherwise("_x")
    wall = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_t0p"), (k % 9 + 1).cast("string")))
    full = F.concat(F.lit("LAT"), kind, F.lit("_i"), size.cast("string"), F.when(size % 2 == 0, "p5").otherwise(""), F.lit("_d"),
                    F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit("p")), wall, F.lit("_s"), (k % 6).cast("string"), F.lit("_m1p6"))
    return t.part.select("p_partkey", F.when(k % 11 == 0, F.lit("5cube_seed")).otherwise(full).alias("stem"))


@query("parse_stems", f"""WITH {_STEM}, r AS (SELECT *, p_partkey % 11 = 0 AS legacy,
 nullif(regexp_extract(stem, '_i([0-9]+p?[0-9]*)', 1), '') AS i, nullif(regexp_extract(stem, '_d([0-9]+p?[0-9]*)', 1), '') AS d, nullif(regexp_extract(stem, '_t([0-9]+p?[0-9]*)', 1), '') AS w,
 nullif(regexp_extract(stem, '_s([0-9]+)\\b', 1), '') AS sd, nullif(regexp_extract(stem, '_m([0-9]+p?[0-9]*)', 1), '') AS m, nullif(regexp_extract(stem, '(?i)LAT[_ ]?(DF|raw|flow)', 1), '') AS v FROM s)
SELECT p_partkey, coalesce(lower(v), 'df') AS variant, coalesce(CAST(replace(i, 'p', '.') AS DOUBLE), CASE WHEN legacy THEN 15.0 END) AS inner_size, CAST(replace(d, 'p', '.') AS DOUBLE) AS density,
 coalesce(CAST(replace(w, 'p', '.') AS DOUBLE), CASE WHEN legacy THEN 0.4 END) AS wall, coalesce(CAST(sd AS INT), CASE WHEN legacy THEN 2 END) AS seed, coalesce(CAST(replace(m, 'p', '.') AS DOUBLE), CASE WHEN legacy THEN 1.6 END) AS size_multi FROM r""")
def parse_stems(t):
    p = _stems(t).withColumn("p", names.parse_stem("stem", "LAT"))
    return p.select("p_partkey", "p.variant", F.col("p.inner").alias("inner_size"), "p.density", F.col("p.t").alias("wall"), "p.seed", "p.size_multi")


@query("parse_slots", f"""WITH {_STEM} SELECT p_partkey, CASE WHEN regexp_matches(stem, 'i([0-9]+)p([0-9]+)') THEN regexp_extract(stem, 'i([0-9]+)p([0-9]+)', 1) || '.' || regexp_extract(stem, 'i([0-9]+)p([0-9]+)', 2) END AS inner_size,
 CASE WHEN regexp_matches(stem, 'd([0-9]+)p([0-9]+)') THEN regexp_extract(stem, 'd([0-9]+)p([0-9]+)', 1) || '.' || regexp_extract(stem, 'd([0-9]+)p([0-9]+)', 2) END AS density, nullif(regexp_extract(stem, '_s([0-9]+)', 1), '') AS seed FROM s""")
def parse_slots(t):
    p = _stems(t).withColumn("p", names.parse_slots("stem", names.DEFAULT_SLOT_SPEC + "; nonsense; other:x(\\d); t:(["))
    return p.select("p_partkey", F.col("p.inner").alias("inner_size"), "p.density", "p.seed")


@query("build_stems", """SELECT p_partkey, concat_ws('_', 'LAT_df', 'i' || CASE WHEN p_size % 10 = 0 THEN p_size // 10 || 'p0' ELSE p_size // 10 || 'p' || p_size % 10 END,
 'd' || replace(regexp_replace(printf('%.2f', p_retailprice), '0$', ''), '.', 'p'), CASE WHEN p_partkey % 3 <> 0 THEN 't0p' || (p_partkey % 3) END, 's' || p_partkey % 6, 'm1p6') AS stem FROM part""")
def build_stems(t):
    k = F.col("p_partkey")
    s = names.build_stem("LAT_df", F.col("p_size") / 10, "p_retailprice", F.when(k % 3 != 0, k % 3 * 0.1), k % 6, F.lit(1.6))
    return t.part.select("p_partkey", s.alias("stem"))


@query("stem_round_trip", """SELECT p_partkey, p_size / 10 AS inner_size, p_retailprice AS density, CAST(NULL AS INT) AS seed FROM part""")
def stem_round_trip(t):
    k = F.col("p_partkey")
    s = names.build_stem("LAT_df", F.col("p_size") / 10, "p_retailprice", F.lit(0.4), k % 6, F.lit(1.6))
    p = t.part.select("p_partkey", names.parse_stem(s, "LAT").alias("p"))
    return p.select("p_partkey", F.col("p.inner").alias("inner_size"), "p.density", "p.seed")


@query("last_number", "SELECT page_id, CAST(regexp_extract_all(url, '[0-9]*[.]?[0-9]+')[-1] AS DOUBLE) AS n FROM pages")
def last_number(t):
    return t.pages.select("page_id", names.last_number("url").alias("n"))


@query("file_stems", f"WITH {_STEM} SELECT p_partkey, stem FROM s")
def file_stems(t):
    s = _stems(t).withColumn("file", F.concat("stem", F.when(F.col("p_partkey") % 3 == 0, ".stl").when(F.col("p_partkey") % 3 == 1, ".STL").otherwise("")))
    return s.select("p_partkey", names.strip_suffix("file").alias("stem"))


@query("seed_labels", "SELECT p_partkey, 'seed ' || CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 50 END AS label FROM part")
def seed_labels(t):
    k = F.col("p_partkey")
    run = F.concat(F.lit("20260808_0118"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("_seed"), (k % 50).cast("string"))).otherwise(F.concat(F.lit("_SEED-"), (k % 50).cast("string"))))
    return t.part.select("p_partkey", names.seed_label(run).alias("label"))


@query("batch_times", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE, '%Y-%m-%d %H:%M') AS at FROM orders")
def batch_times(t):
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    batch = F.concat(F.date_format(at, "yyyyMMdd_HH-mm"), F.lit("_RUN"))
    return t.orders.select("o_orderkey", F.date_format(names.batch_time(batch), "yyyy-MM-dd HH:mm").alias("at"))


@query("folded_names", "SELECT DISTINCT p_name, 'rho' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS folded FROM part")
def folded_names(t):
    return t.part.select("p_name", names.fold_name(F.concat(F.lit("Ρ_ "), F.upper("p_name"))).alias("folded")).distinct()


@query("group_keys", """SELECT c_custkey, c_mktsegment || '|' || coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END, '?') || '|' || CAST(trunc(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 10000 ELSE c_nationkey * 0.013 END / 0.02) AS INT) AS group_key
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def group_keys(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    topo = names.topology_of(F.lit(" "), F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")))
    band = names.density_band(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") / 10000), F.col("c_nationkey") * F.lit(0.013), 0.02)
    return c.select("c_custkey", names.group_key("c_mktsegment", topo, band).alias("group_key"))


@query("wall_expectation", """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 0.2::DOUBLE END AS wall, round(CASE WHEN p_partkey % 3 <> 0 THEN p_size * 0.2::DOUBLE * 1.5 ELSE 0.4 * 3 END, 6) AS cap FROM part""")
def wall_expectation(t):
    w = names.expected_wall(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * F.lit(0.1)), "double")
    return t.part.select("p_partkey", w.alias("wall"), F.round(names.search_cap(w, 1.5, 0.4, 3.0), 6).alias("cap"))


@query("inner_sizes", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1.0 ELSE round_even(p_retailprice * 2, 0) / 2 END AS inner_size FROM part""")
def inner_sizes(t):
    stem = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("x_i"), F.col("p_size").cast("string"), F.lit("p0_s1"))).otherwise("none")
    return t.part.select("p_partkey", names.inner_size(stem, "p_retailprice").alias("inner_size"))


@query("unit_conversion", """SELECT event_id, round(value * CASE event_type WHEN 'error' THEN 1e-9 WHEN 'click' THEN 1e-6 WHEN 'view' THEN 1e-3 WHEN 'signup' THEN 1.0 END, 12) AS gpa FROM events""")
def unit_conversion(t):
    u = F.when(F.col("event_type") == "error", " pa").when(F.col("event_type") == "click", "kPa").when(F.col("event_type") == "view", "MPa").when(F.col("event_type") == "signup", "GPa").otherwise("psi")
    return t.events.select("event_id", F.round(units.to_gpa("value", u), 12).alias("gpa"))


@query("normalised_labels", """SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS "E_over_Es", round(l_extendedprice * 1e-3 / 200, 9) AS "C11_n", round(l_quantity / 250, 9) AS onset_n, CAST(NULL AS DOUBLE) AS shear_onset_n FROM lineitem""")
def normalised_labels(t):
    L = units.Label
    labels = (L("l_discount", "E_over_Es"), L("l_extendedprice", "C11_n", "Es", "MPa"), L("l_quantity", "onset_n", "sigma_ys", "MPa"), L("absent", "shear_onset_n", "sigma_ys", "MPa"))
    out = units.normalise_labels(t.lineitem, labels, keep=["l_orderkey", "l_linenumber", "l_partkey"])
    return out.withColumns({"C11_n": F.round("C11_n", 9), "onset_n": F.round("onset_n", 9)})


@query("result_status", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'FAIL: stiffness file is missing or empty' WHEN o_orderkey % 11 = 0 THEN 'FAIL: stiffness file is unreadable' WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'OK'
 WHEN o_orderstatus = 'F' THEN 'OK without stress of shear' WHEN o_totalprice > 200000 THEN 'OK without stress of compression' ELSE 'OK without stress of compression and shear' END AS status FROM orders""")
def result_status(t):
    k = F.col("o_orderkey")
    s = units.result_status(F.when(k % 7 != 0, 500), k % 11 != 0, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000)
    return t.orders.select("o_orderkey", s.alias("status"))


@query("measured_length", """WITH f AS (SELECT p_partkey, p_size * 1.0 AS SAV_x_cell, p_retailprice / 2000 AS VF, p_size * 0.5 AS curv_gauss_iqr_xL2, p_retailprice / 9001.23457 AS thickness_over_cell, p_size * 2.0 AS bbox_mm, CASE WHEN p_partkey % 2 = 0 THEN 3.0 ELSE 10.0 END AS L FROM part),
l AS (SELECT *, 1 / (SAV_x_cell / L * VF) AS Ls FROM f)
SELECT p_partkey, round(Ls, 6) AS "L_star_mm", round(SAV_x_cell * Ls / L, 6) AS "SAV_x_cell_star", round(curv_gauss_iqr_xL2 * pow(Ls / L, 2), 6) AS "curv_gauss_iqr_xL2_star", round(thickness_over_cell / (Ls / L), 6) AS thickness_over_cell_star, round(bbox_mm / Ls, 6) AS "bbox_over_Lstar" FROM l""")
def measured_length(t):
    p = t.part.select("p_partkey", F.col("p_size").alias("SAV_x_cell"), (F.col("p_retailprice") / 2000).alias("VF"), (F.col("p_size") * 0.5).alias("curv_gauss_iqr_xL2"),
                      (F.col("p_retailprice") / 9001.23457).alias("thickness_over_cell"), (F.col("p_size") * 2).alias("bbox_mm"), F.when(F.col("p_partkey") % 2 == 0, 3.0).otherwise(10.0).alias("cell"))
    out = units.add_measured_length(p, "cell")
    cols = ["L_star_mm", "SAV_x_cell_star", "curv_gauss_iqr_xL2_star", "thickness_over_cell_star", "bbox_over_Lstar"]
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in cols])


@query("log_targets", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0 THEN log10(l_discount) END, 9) AS lg, round(CASE WHEN l_discount > 0 THEN l_discount END, 9) AS back FROM lineitem""")
def log_targets(t):
    lg = units.log_target("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(lg, 9).alias("lg"), F.round(units.unlog_target(lg), 9).alias("back"))


@query("log_allowed", """SELECT 'l_discount' AS target, min(l_discount) AS lowest, min(l_discount) > 0 AS use_log FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), min(l_extendedprice) > 0 FROM lineitem""")
def log_allowed(t):
    return units.log_allowed(t.lineitem, ["l_discount", "l_extendedprice"])
