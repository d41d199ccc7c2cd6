"""Mesh queries over the meshes that `shapes` derives from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.catalog.shapes import BOX, CORNER, EDGE, FACE, TRI, VERTEX, meshes
from trabecula.functions import gates, vec
from trabecula.operators import mesh


def _round(df, key, cols, d=6):
    return df.select(*key, *[F.round(c, d).alias(c) for c in cols])


_DET = "(ax * (dy * cz - dz * cy) + ay * (dz * cx - dx * cz) + az * (dx * cy - dy * cx)) / 6"


@query("mesh_measures", f"""WITH {TRI}, {FACE}, {BOX}, m AS (SELECT mesh_id, count(*) AS n_tris, abs(sum({_DET})) AS volume, sum(area) AS area FROM f GROUP BY 1)
SELECT mesh_id, n_tris, round(volume, 6) AS volume, round(area, 6) AS area, round(hix - lox, 6) AS box_x, round(volume / ((hix - lox) * (hiy - loy) * (hiz - loz)), 6) AS vf, round(area / volume, 5) AS "SAV_x_cell", round(area / ((hix - lox) * (hiy - loy) * (hiz - loz)), 6) AS rel_surface FROM m JOIN box USING (mesh_id)""")
def mesh_measures(t):
    m = mesh.measures(meshes(t.part))
    return m.select("mesh_id", "n_tris", *[F.round(c, 6).alias(c) for c in ("volume", "area", "box_x", "vf", "rel_surface")], F.round("SAV_x_cell", 5).alias("SAV_x_cell"))


@query("mesh_measures_nominal", f"""WITH {TRI}, m AS (SELECT mesh_id, abs(sum({_DET})) AS volume FROM tri GROUP BY 1) SELECT mesh_id, round(volume / 27, 7) AS vf, 'nominal cell' AS vf_basis FROM m""")
def mesh_measures_nominal(t):
    return mesh.measures(meshes(t.part), cell=3.0).select("mesh_id", F.round("vf", 7).alias("vf"), "vf_basis")


_EDGES = "eg AS (SELECT mesh_id, lo, hi, count(*) AS n, sum(way) AS bal FROM eh GROUP BY 1, 2, 3)"


@query("mesh_topology", f"""WITH {TRI}, {FACE}, {CORNER}, {EDGE}, {_EDGES}, a AS (SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (n <> 2) = 0 AS watertight, count(*) FILTER (n = 2 AND bal <> 0) = 0 AS winding_ok FROM eg GROUP BY 1),
v AS (SELECT mesh_id, count(*) AS n_vertices FROM (SELECT DISTINCT mesh_id, px, py, pz FROM cr) GROUP BY 1), c AS (SELECT mesh_id, count(*) AS n_tris FROM tri GROUP BY 1)
SELECT mesh_id, n_edges, watertight, winding_ok, n_vertices, n_tris, n_vertices - n_edges + n_tris AS euler FROM a JOIN v USING (mesh_id) JOIN c USING (mesh_id)""")
def mesh_topology(t):
    return mesh.topology(meshes(t.part))


@query("mesh_bodies", "SELECT p_partkey AS mesh_id, CASE WHEN p_partkey % 10 = 3 THEN 2 ELSE 1 END::BIGINT AS bodies FROM part")
def mesh_bodies(t):
    return mesh.bodies(meshes(t.part))


@query("mesh_health", """SELECT p_partkey AS mesh_id, p_partkey % 10 NOT IN (1, 2, 3) AS ok, CASE p_partkey % 10 WHEN 1 THEN 'V - E + F = 1 is odd; surface has open edges' WHEN 2 THEN 'faces turn both ways' WHEN 3 THEN '2 parts instead of one' ELSE '' END AS detail FROM part""")
def mesh_health(t):
    r = mesh.report(meshes(t.part)).withColumn("g", gates.mesh_gate())
    return r.select("mesh_id", "g.ok", "g.detail")


_IN = " AND ".join(f"p{a} > lo{a} + 0.02 * (hi{a} - lo{a}) AND p{a} < hi{a} - 0.02 * (hi{a} - lo{a})" for a in "xyz")


@query("mesh_interior", f"""WITH {TRI}, {FACE}, {CORNER}, {BOX}, v AS (SELECT DISTINCT mesh_id, px, py, pz FROM cr)
SELECT mesh_id, count(*) AS n_vertices, count(*) FILTER ({_IN}) AS n_interior, round(count(*) FILTER ({_IN}) / count(*), 6) AS interior_vert_frac FROM v JOIN box USING (mesh_id) GROUP BY 1""")
def mesh_interior(t):
    return mesh.interior_share(meshes(t.part), 0.02).withColumn("interior_vert_frac", F.round("interior_vert_frac", 6))


@query("mesh_gauss_curvature", f"WITH {TRI}, {FACE}, {CORNER}, {VERTEX} SELECT mesh_id, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, round(dual, 6) AS dual, round(gauss, 5) AS gauss FROM vt")
def mesh_gauss_curvature(t):
    v = mesh.vertex_table(meshes(t.part))
    return v.select("mesh_id", *[F.round(F.col(f"pos.{a}"), 6).alias(a) for a in vec.AXES], F.round("dual", 6).alias("dual"), F.round("gauss", 5).alias("gauss"))


_PULL = " + ".join(f"u{a} * l{a}" for a in "xyz")


@query("mesh_cotangent_curvature", f"""WITH {TRI}, {FACE}, {CORNER}, {VERTEX}, ct AS (SELECT mesh_id, tri_id, px, py, pz, cos(ang) / sin(ang) AS ct FROM cr),
k AS (SELECT c.mesh_id, c.px, c.py, c.pz, c.ox - c.px AS gx, c.oy - c.py AS gy, c.oz - c.pz AS gz, d.ct FROM cr c JOIN ct d ON c.mesh_id = d.mesh_id AND c.tri_id = d.tri_id AND d.px = c.ex AND d.py = c.ey AND d.pz = c.ez
 UNION ALL SELECT c.mesh_id, c.px, c.py, c.pz, c.ex - c.px, c.ey - c.py, c.ez - c.pz, d.ct FROM cr c JOIN ct d ON c.mesh_id = d.mesh_id AND c.tri_id = d.tri_id AND d.px = c.ox AND d.py = c.oy AND d.pz = c.oz),
l AS (SELECT mesh_id, px, py, pz, sum(ct * gx) AS lx, sum(ct * gy) AS ly, sum(ct * gz) AS lz FROM k GROUP BY 1, 2, 3, 4)
SELECT mesh_id, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, round(-0.5 * ({_PULL}) / (2 * dual), 5) AS mean_cot FROM vt JOIN l USING (mesh_id, px, py, pz)""")
def mesh_cotangent_curvature(t):
    v = mesh.vertex_table(meshes(t.part))
    return v.select("mesh_id", *[F.round(F.col(f"pos.{a}"), 6).alias(a) for a in vec.AXES], F.round("mean_cot", 5).alias("mean_cot"))


@query("mesh_edge_curvature", f"WITH {TRI}, {FACE}, {CORNER}, {EDGE} SELECT mesh_id, count(*) AS n_edges, round(sum(H * w), 5) AS total, round(min(H), 5) AS lowest, round(max(H), 5) AS highest, count(*) FILTER (H < -1e-6) AS n_concave FROM ed GROUP BY 1")
def mesh_edge_curvature(t):
    e = mesh.edge_curvature(meshes(t.part))
    return e.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum(F.col("mean") * F.col("weight")), 5).alias("total"), F.round(F.min("mean"), 5).alias("lowest"),
                                    F.round(F.max("mean"), 5).alias("highest"), F.count_if(F.col("mean") < -1e-6).alias("n_concave"))


@query("mesh_vertex_mean_curvature", f"""WITH {TRI}, {FACE}, {CORNER}, {EDGE}, s AS (SELECT mesh_id, lo AS v, H, w FROM ed UNION ALL SELECT mesh_id, hi, H, w FROM ed), g AS (SELECT mesh_id, v, sum(H * w) / sum(w) AS h FROM s GROUP BY 1, 2)
SELECT mesh_id, count(*) AS n, round(sum(h), 5) AS total, round(max(h), 5) AS highest FROM g GROUP BY 1""")
def mesh_vertex_mean_curvature(t):
    v = mesh.vertex_mean_curvature(meshes(t.part))
    return v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean_dihedral"), 5).alias("total"), F.round(F.max("mean_dihedral"), 5).alias("highest"))


@query("mesh_domain_mask", f"""WITH {TRI}, {FACE}, {CORNER}, v AS (SELECT DISTINCT mesh_id, px, py, pz FROM cr) SELECT mesh_id, count(*) FILTER (abs(px) <= 0.95 AND abs(py) <= 0.95 AND abs(pz) <= 0.95) AS n_inside FROM v GROUP BY 1""")
def mesh_domain_mask(t):
    v = mesh.vertex_table(meshes(t.part))
    return v.groupBy("mesh_id").agg(F.count_if(mesh.in_domain("pos", 2.0, 0.05)).alias("n_inside"))


@query("mesh_curvature_summary", f"""WITH {TRI}, {FACE}, {CORNER}, {VERTEX}, {EDGE},
a AS (SELECT mesh_id, sum(gauss * dual) / sum(dual) * 9 AS g, (quantile_cont(gauss, 0.75) - quantile_cont(gauss, 0.25)) * 9 AS gi, quantile_cont(abs(gauss), 0.99) * 9 AS gp FROM vt GROUP BY 1),
b AS (SELECT mesh_id, sum(H * w) / sum(w) * 3 AS m, (quantile_cont(H, 0.75) - quantile_cont(H, 0.25)) * 3 AS mi, quantile_cont(abs(H), 0.99) * 3 AS mp FROM ed GROUP BY 1)
SELECT mesh_id, round(g, 4) AS "curv_gauss_mean_xL2", round(m, 4) AS "curv_mean_mean_xL", round(gi, 4) AS "curv_gauss_iqr_xL2", round(gp, 4) AS "curv_gauss_p99_xL2", round(mi, 4) AS "curv_mean_iqr_xL", round(mp, 4) AS "curv_mean_p99_xL" FROM a JOIN b USING (mesh_id)""")
def mesh_curvature_summary(t):
    out = mesh.curvature_summary(meshes(t.part), 3.0, skin=None)
    return _round(out, ["mesh_id"], [c for c in out.columns if c != "mesh_id"], 4)


@query("mesh_interior_curvature", f"""WITH {TRI}, {FACE}, {CORNER}, {VERTEX}, {BOX}
SELECT mesh_id, count(*) AS n, round(sum(gauss * dual) / sum(dual), 5) AS gauss FROM vt JOIN box USING (mesh_id) WHERE {_IN} GROUP BY 1""")
def mesh_interior_curvature(t):
    tri = meshes(t.part)
    v = mesh.vertex_table(tri).join(mesh.boxes(tri).hint("merge"), "mesh_id").where(mesh.interior("pos", 0.02))
    return v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("gauss") * F.col("dual")) / F.sum("dual"), 5).alias("gauss"))


_WALL = f"""WITH {TRI}, {FACE}, {CORNER}, {VERTEX}, p AS (SELECT a.mesh_id, a.px, a.py, a.pz, sqrt(pow(b.px - a.px, 2) + pow(b.py - a.py, 2) + pow(b.pz - a.pz, 2)) AS d,
 -((b.px - a.px) * a.ux + (b.py - a.py) * a.uy + (b.pz - a.pz) * a.uz) AS inward, b.ux * a.ux + b.uy * a.uy + b.uz * a.uz AS opp FROM vt a JOIN vt b ON a.mesh_id = b.mesh_id),
h AS (SELECT mesh_id, px, py, pz, min(d) FILTER (d > 1e-3 AND d <= 2.5 AND inward > 0.6 * d AND opp < -0.3) AS d FROM p GROUP BY 1, 2, 3, 4)"""


@query("mesh_wall_hits", _WALL + " SELECT mesh_id, count(*) AS n_samples, count(d) AS n_hits, round(min(d), 6) AS nearest, round(sum(d), 5) AS total FROM h GROUP BY 1")
def mesh_wall_hits(t):
    h = mesh.wall_hits(meshes(t.part), 2.5, skin=None)
    return h.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_samples"), F.count("distance").alias("n_hits"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.sum("distance"), 5).alias("total"))


@query("mesh_wall_summary", _WALL + """ SELECT mesh_id, count(d) AS thickness_hits, CASE WHEN count(d) > 3 THEN round(quantile_cont(d, 0.5), 6) END AS thickness_med_mm, CASE WHEN count(d) > 3 THEN round(stddev_pop(d), 5) END AS thickness_std_mm, CASE WHEN count(d) > 3 THEN round(quantile_cont(d, 0.5) / 1.5, 6) END AS thickness_ratio FROM h GROUP BY 1""")
def mesh_wall_summary(t):
    h = mesh.wall_hits(meshes(t.part), 2.5, skin=None)
    want = t.part.select(F.col("p_partkey").alias("mesh_id"), F.lit(1.5).alias("expected"))
    s = mesh.wall_summary(h, want, 3.0, 3)
    return s.select("mesh_id", "thickness_hits", F.round("thickness_med_mm", 6).alias("thickness_med_mm"), F.round("thickness_std_mm", 5).alias("thickness_std_mm"), F.round("thickness_ratio", 6).alias("thickness_ratio"))


_CUT = " AND ".join(f"NOT (((a{a} + d{a} + c{a}) / 3 < lo{a} + 0.05 * (hi{a} - lo{a}) OR (a{a} + d{a} + c{a}) / 3 > hi{a} - 0.05 * (hi{a} - lo{a})) AND abs(n{a}) > 0.9)" for a in "xyz")


@query("mesh_fabric", f"""WITH {TRI}, {FACE}, {BOX}, k AS (SELECT f.*, {_CUT} AS keep FROM f JOIN box USING (mesh_id)),
g AS (SELECT mesh_id, count(*) AS n, count(*) FILTER (keep) AS kept, sum(area) FILTER (keep) AS w, sum(area * nx * nx) FILTER (keep) AS xx, sum(area * ny * ny) FILTER (keep) AS yy, sum(area * nz * nz) FILTER (keep) AS zz, sum(area * nx * ny) FILTER (keep) AS xy, sum(area * nx * nz) FILTER (keep) AS xz, sum(area * ny * nz) FILTER (keep) AS yz FROM k GROUP BY 1),
q AS (SELECT mesh_id, n, kept, CASE WHEN kept >= 8 THEN xx / w END AS xx, CASE WHEN kept >= 8 THEN yy / w END AS yy, CASE WHEN kept >= 8 THEN zz / w END AS zz, xy / w AS xy, xz / w AS xz, yz / w AS yz FROM g)
SELECT mesh_id, kept AS n_kept, round(xx, 6) AS normal_x, round(yy, 6) AS normal_y, round(zz, 6) AS normal_z, round(sqrt((pow(xx - 1/3, 2) + pow(yy - 1/3, 2) + pow(zz - 1/3, 2)) / 3), 6) AS normal_spread,
 CASE WHEN kept >= 8 THEN round(kept / n, 6) END AS fabric_kept_frac, CASE WHEN kept >= 8 THEN 1.0::DOUBLE END AS trace, CASE WHEN kept >= 8 THEN round(xx*(yy*zz-yz*yz) - xy*(xy*zz-yz*xz) + xz*(xy*yz-yy*xz), 7) END AS product FROM q""")
def mesh_fabric(t):
    f = mesh.fabric(meshes(t.part), skin=0.05, min_faces=8)
    l1, l2, l3 = (F.col(f"fabric_l{i}") for i in (1, 2, 3))
    return f.select("mesh_id", "n_kept", *[F.round(c, 6).alias(c) for c in ("normal_x", "normal_y", "normal_z", "normal_spread", "fabric_kept_frac")],
                    F.round(l1 + l2 + l3, 6).alias("trace"), F.round(l1 * l2 * l3, 7).alias("product"))


@query("mesh_welded_vertices", f"WITH {TRI}, {FACE}, {CORNER} SELECT mesh_id, count(*) AS n_vertices FROM (SELECT DISTINCT mesh_id, round(px, 8), round(py, 8), round(pz, 8) FROM cr) GROUP BY 1")
def mesh_welded_vertices(t):
    tri = meshes(t.part)
    v = tri.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("p"))
    return v.select("mesh_id", mesh.weld_key("p").alias("k")).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"))
