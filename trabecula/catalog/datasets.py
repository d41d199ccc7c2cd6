"""Whole dataset builds: parts stand for aperiodic geometries and tensors, suppliers for periodic geometries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.catalog.shapes import FACE, TRI, dealt, meshes
from trabecula.catalog.tensors import _ORTHO, _ortho
from trabecula.operators import folds
from trabecula.plans import dataset, features

_STEM = "'LAT_df_i15p0_d' || (p_partkey // 2) || 'p0_t0p4_m1p6_s' || (p_partkey % 2 + 2)"


def _aperiodic_tables(t):
    """Every part has two versions of its labels; neighbours share a geometry and differ in seed."""
    k = F.col("p_partkey")
    stem = F.concat(F.lit("LAT_df_i15p0_d"), F.floor(k / 2).cast("string"), F.lit("p0_t0p4_m1p6_s"), (k % 2 + 2).cast("string"))
    part = dealt(t.part)
    feats = part.select(F.concat(stem, F.lit(".stl")).alias("file"), F.when(k % 13 == 0, "ERROR bad mesh").otherwise("OK").alias("status"),
                          (F.col("p_size") / 60).alias("VF"), (F.col("p_size") * 0.5 + 3).alias("SAV_x_cell"))
    m = part.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    known = F.col("p_size") % 9 != 0
    master = m.select(stem.alias("Run"), F.concat(F.lit("v"), F.col("v").cast("string")).alias("Version"), F.lit("OK").alias("Status"),
                      F.when(known, F.col("p_retailprice") * F.col("v")).alias("C11_GPa"), F.when(known, F.col("p_size") / 100 * F.col("v")).alias("E_over_Es"), (k * 10 + F.col("v")).alias("seq"))
    return feats, master


def _aperiodic(t):
    return dataset.aperiodic_dataset(*_aperiodic_tables(t), "LAT")


@query("dataset_aperiodic_losses", """WITH u AS (SELECT p_partkey % 7 = 0 AS lone, p_size % 9 = 0 AS bare FROM part WHERE p_partkey % 13 <> 0)
SELECT mode, count(*) FILTER (lone) AS unmatched, count(*) FILTER (NOT lone AND bare) AS without_labels, count(*) AS total,
       CASE WHEN count(*) FILTER (lone) > 0.2 * count(*) THEN 'too many unmatched' ELSE 'ok' END AS verdict FROM u, (VALUES ('params'), ('file')) m(mode) GROUP BY 1""")
def dataset_aperiodic_losses(t):
    """A seventh of the runs is missing from the master."""
    feats, master = _aperiodic_tables(t)
    runs = t.part.where(F.col("p_partkey") % 7 != 0).select(F.concat(F.lit("LAT_df_i15p0_d"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit("p0_t0p4_m1p6_s"), (F.col("p_partkey") % 2 + 2).cast("string")).alias("Run"))
    master, out = master.join(runs, "Run", "left_semi"), None
    for mode in ("params", "file"):
        unmatched, bare, guard = dataset.aperiodic_losses(feats, master, "LAT", join_on=mode)
        n = unmatched.agg(F.count(F.lit(1)).alias("unmatched")).select(F.struct("unmatched").alias("r")).scalar()
        m = bare.agg(F.count(F.lit(1)).alias("n")).select(F.struct("n").alias("r")).scalar()
        row = guard.select(F.lit(mode).alias("mode"), n["unmatched"].alias("unmatched"), m["n"].alias("without_labels"), "total", "verdict")
        out = row if out is None else out.unionByName(row)
    return out


@query("feature_table", f"""WITH {TRI}, {FACE}, s AS (SELECT mesh_id, count(*) AS n_tris, round(sum(area), 6) AS area FROM f GROUP BY 1)
SELECT p_partkey AS mesh_id, CASE WHEN p_partkey % 11 = 0 THEN 'SKIPPED' WHEN p_partkey % 17 = 0 THEN 'ERROR no triangles' ELSE 'OK' END AS status, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 17 <> 0 THEN n_tris END AS n_tris,
 CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 17 <> 0 THEN area END AS area, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 17 <> 0 THEN p_partkey % 10 <> 1 END AS watertight FROM part JOIN s ON mesh_id = p_partkey""")
def feature_table(t):
    """One file in eleven was skipped and one in seventeen holds no triangle."""
    k = F.col("mesh_id")
    files = t.part.select(F.col("p_partkey").alias("mesh_id")).withColumn("status", F.when(k % 11 == 0, "SKIPPED").otherwise("OK"))
    out = features.feature_table(meshes(t.part).where((k % 11 != 0) & (k % 17 != 0)), files, 3.0, 2.5)
    return out.select("mesh_id", "status", "n_tris", F.round("area", 6).alias("area"), "watertight")


_AP = f"""ap AS (SELECT p_partkey // 2 AS g, arg_min(p_partkey, p_partkey) AS k FROM part WHERE p_partkey % 13 <> 0 AND p_size % 9 <> 0 GROUP BY 1)"""


@query("dataset_aperiodic", f"""WITH {_AP} SELECT {_STEM} AS Run, 'df' AS variant, round(p_retailprice * 2 / 200, 6) AS "C11_n", round(p_size / 100 * 2, 6) AS "E_over_Es", round(p_size / 60, 6) AS "VF" FROM ap JOIN part ON p_partkey = k""")
def dataset_aperiodic(t):
    return _aperiodic(t).select("Run", "variant", *[F.round(c, 6).alias(c) for c in ("C11_n", "E_over_Es", "VF")])


def _periodic(t):
    """Tensors per (brand, density), some brands under their alias; features whose name and measured density may disagree."""
    k = F.col("p_partkey")
    brand = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, " Generator").otherwise(""))
    tensors = _ortho(t, "p_brand", "p_size").select(brand.alias("topology"), (k % 6 * 0.05 + 0.1).alias("density"), F.format_string("%012d", k).alias("path"), "c")
    s = F.col("s_suppkey")
    dens = s % 8 * 0.05 + 0.1
    feats = t.supplier.select(F.concat(F.lit("Brand#"), (s % 25 + 1).cast("string"), F.lit(" Generator")).alias("topology"), F.concat(F.lit("S"), s.cast("string"), F.lit("_density"), F.format_string("%.2f", dens), F.lit(".stl")).alias("file"),
                              F.lit("OK").alias("status"), (F.round(dens, 2) * (F.lit(0.8) + s % 5 * 0.1)).alias("VF"), (F.lit(20.0) + s % 7).alias("SAV_x_cell"))
    return dataset.periodic_dataset(feats, tensors, "MPa", 1.8, "GPa", 0.3, excluded=["Brand#3 Generator", "Brand#3"], element_order="quadratic")


_PE = f"""{_ORTHO}, ix AS (SELECT p_brand || CASE WHEN p_size % 2 = 0 THEN ' Generator' ELSE '' END AS topology, CAST(round(p_partkey % 6 * 0.05 + 0.1, 2) AS DECIMAL(12,2)) AS d, p_partkey AS k FROM part WHERE p_brand <> 'Brand#3'),
al AS (SELECT topology, d, k, 0 AS pr FROM ix UNION ALL SELECT topology || ' Generator', d, k, 1 FROM ix WHERE topology NOT LIKE '% Generator'),
best AS (SELECT topology, d, arg_min(k, (pr, k)) AS k FROM al GROUP BY 1, 2),
sf AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) || ' Generator' AS topology, CAST(round(s_suppkey % 8 * 0.05 + 0.1, 2) AS DECIMAL(12,2)) AS d, 0.8 + s_suppkey % 5 * 0.1 AS r FROM supplier),
hit AS (SELECT sf.*, best.k FROM sf JOIN best ON sf.topology = best.topology AND sf.d = best.d)"""


@query("dataset_periodic", f"""WITH {_PE} SELECT 'S' || s_suppkey || '_density' || printf('%.2f', CAST(d AS DOUBLE)) AS Run, topology, round(E_iso * 0.001 / 1.8, 9) AS "E_over_Es", round(a1 * 0.001 / 1.8, 9) AS "C11_n", round(CAST(d AS DOUBLE) * r, 6) AS "Rho_rel",
 'periodic|' || topology || '|' || CAST(trunc(CAST(d AS DOUBLE) * r / 0.02) AS INT) AS group_key FROM hit JOIN x ON x.p_partkey = k WHERE r > 0.85 AND r < 1.15""")
def dataset_periodic(t):
    d = _periodic(t)[0]
    return d.select("Run", "topology", F.round("E_over_Es", 9).alias("E_over_Es"), F.round("C11_n", 9).alias("C11_n"), F.round("Rho_rel", 6).alias("Rho_rel"), "group_key")


@query("dataset_periodic_losses", f"WITH {_PE} SELECT 'rejected' AS kind, count(*) AS n FROM hit WHERE NOT (r > 0.85 AND r < 1.15) UNION ALL SELECT 'missed', count(*) FROM sf WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.topology = sf.topology AND best.d = sf.d)")
def dataset_periodic_losses(t):
    _, rejected, missed = _periodic(t)
    both = rejected.select(F.lit("rejected").alias("kind")).unionByName(missed.select(F.lit("missed").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_combined", f"""WITH {_PE}, {_AP}, u AS (SELECT 'aperiodic' AS family, 1 / ((p_size * 0.5 + 3) / 3 * (p_size / 60)) AS ls FROM ap JOIN part ON p_partkey = k
 UNION ALL SELECT 'periodic', 1 / ((20.0 + s_suppkey % 7) / 10 * (CAST(d AS DOUBLE) * r)) FROM hit WHERE r > 0.85 AND r < 1.15)
SELECT family, count(*) AS n, round(sum(ls), 4) AS total_length FROM u GROUP BY 1""")
def dataset_combined(t):
    both = dataset.combined_dataset(_aperiodic(t), _periodic(t)[0], "aperiodic", "periodic", 3.0, 10.0, "quadratic", "quadratic")
    return both.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("L_star_mm"), 4).alias("total_length"))


@query("dataset_group_sizes", f"""WITH {_PE}, g AS (SELECT topology, CAST(trunc(CAST(d AS DOUBLE) * r / 0.02) AS INT) AS b, count(*) AS n FROM hit WHERE r > 0.85 AND r < 1.15 GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM g""")
def dataset_group_sizes(t):
    return folds.group_counts(_periodic(t)[0], "group_key")
