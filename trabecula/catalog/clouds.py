"""Point-cloud queries (G15-G22, M18). Clouds are mesh corners, or points sampled on the meshes of the part table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.catalog.shapes import FACE, TRI, dealt, meshes
from trabecula.catalog.tensors import _ortho
from trabecula.functions import vec
from trabecula.functions.core import spread_join
from trabecula.operators import cloud, mesh
from trabecula.plans import augmented

_N = 48
_FULL = 2048


def _corners(t):
    """Every corner of every triangle as a point with a stable index."""
    c = F.inline(F.array(*[F.struct((F.col("tri_id") * 3 + i).cast("int").alias("i"), *[F.col(f"v{i}.{a}").alias(a) for a in vec.AXES]) for i in range(3)]))
    return meshes(t.part).select("mesh_id", c)


_PTS = f"""WITH {TRI}, pt AS (SELECT mesh_id, CAST(tri_id * 3 AS INT) AS i, ax AS x, ay AS y, az AS z FROM tri UNION ALL SELECT mesh_id, CAST(tri_id * 3 + 1 AS INT), dx, dy, dz FROM tri UNION ALL SELECT mesh_id, CAST(tri_id * 3 + 2 AS INT), cx, cy, cz FROM tri),
st AS (SELECT mesh_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM pt GROUP BY 1),
nb AS (SELECT mesh_id, i, (x - mx) / e AS x, (y - my) / e AS y, (z - mz) / e AS z FROM pt JOIN st USING (mesh_id))"""


@query("cloud_unit_box", _PTS + " SELECT mesh_id, i, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM nb")
def cloud_unit_box(t):
    return cloud.to_unit_box(_corners(t)).select("mesh_id", "i", *[F.round(a, 6).alias(a) for a in vec.AXES])


@query("cloud_check", _PTS + " SELECT mesh_id, count(*) AS n_points, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS extent, mesh_id % 3 <> 0 AS ok FROM nb GROUP BY 1")
def cloud_check(t):
    c = cloud.to_unit_box(_corners(t))
    c = c.withColumn("x", F.col("x") + F.when(F.col("mesh_id") % 3 == 0, 0.01).otherwise(0.0))
    return cloud.cloud_check(c).select("mesh_id", "n_points", F.round("extent", 6).alias("extent"), "ok")


@query("cloud_staleness", """SELECT p_partkey, concat_ws('; ', CASE WHEN p_size <> 11 THEN 'n_points' END, CASE WHEN p_partkey % 4 = 0 THEN 'no seed recorded' WHEN p_partkey % 4 <> 2 THEN 'seed' END) AS reason,
 p_size <> 11 OR p_partkey % 4 <> 2 AS stale FROM part""")
def cloud_staleness(t):
    k = F.col("p_partkey")
    s = t.part.select("p_partkey", F.col("p_size").alias("n_points"), F.when(k % 4 != 0, k % 4).alias("seed"))
    return cloud.staleness(s, 11, 2).select("p_partkey", "reason", "stale")


@query("cloud_rebuild_diff", _PTS + """, nw AS (SELECT mesh_id, i, x + CASE WHEN mesh_id % 4 = 0 THEN 0.001 ELSE 1e-9 END AS x, y, z FROM nb WHERE NOT (mesh_id % 7 = 0 AND i = 5))
SELECT o.mesh_id, round(max(abs(o.x - n.x)), 8) AS max_diff, count(*) FILTER (n.i IS NULL) AS n_unpaired, CASE WHEN count(*) FILTER (n.i IS NULL) = 0 AND max(abs(o.x - n.x)) < 1e-6 THEN 'identical' ELSE 'changed' END AS state
FROM nb o LEFT JOIN nw n ON o.mesh_id = n.mesh_id AND o.i = n.i GROUP BY 1""")
def cloud_rebuild_diff(t):
    old = cloud.to_unit_box(_corners(t))
    new = old.where(~((F.col("mesh_id") % 7 == 0) & (F.col("i") == 5))).withColumn("x", F.col("x") + F.when(F.col("mesh_id") % 4 == 0, 0.001).otherwise(1e-9))
    return cloud.rebuild_diff(old, new).withColumn("max_diff", F.round("max_diff", 8))


@query("cloud_density_channel", _PTS + " SELECT mesh_id, count(*) AS n, round(max(p_retailprice), 2) AS density FROM pt JOIN part ON p_partkey = mesh_id WHERE i < 20 GROUP BY 1")
def cloud_density_channel(t):
    d = t.part.select(F.col("p_partkey").alias("mesh_id"), F.col("p_retailprice").alias("density"))
    return cloud.with_density(_corners(t), d, 20).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("density"), 2).alias("density"))


def _indices(pts, n):
    """Points and distinct indices below n per mesh: the indices are kept as bits, so one row per mesh and task is shuffled."""
    words, bit = range(-(-n // 64)), F.expr("shiftleft(1L, cast(i % 64 as int))")
    marked = pts.withColumns({"word": F.when(F.col("i") >= 0, F.expr("i div 64")), "bit": bit}).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_points"), *[F.bit_or(F.when(F.col("word") == w, F.col("bit"))).alias(f"w{w}") for w in words])
    return marked.select("mesh_id", "n_points", sum((F.coalesce(F.bit_count(f"w{w}"), F.lit(0)) for w in words), F.lit(0)).cast("long").alias("n_indices"))


@query("cloud_sample_coverage", f"""WITH {TRI}, {FACE}, a AS (SELECT mesh_id, tri_id, sum(area) OVER (PARTITION BY mesh_id) AS total FROM f)
SELECT mesh_id, {_FULL}::BIGINT AS n_points, {_FULL}::BIGINT AS n_indices, true AS follows_area, round(ln(max(total)) + ln(10) * 12 * (mesh_id % 3 - 1), 6) AS log_area FROM a GROUP BY 1""")
def cloud_sample_coverage(t):
    """Each mesh gets exactly n points at any size, and no triangle is off its expected number by more than two.

    Meshes are scaled by a millionth, one or a million by their number.
    """
    factor = F.element_at(F.array(*[F.lit(x) for x in (1e-6, 1.0, 1e6)]), (F.col("mesh_id") % 3 + 1).cast("int"))
    tri = meshes(t.part).withColumns({v: F.struct(*[(F.col(f"{v}.{a}") * factor).alias(a) for a in vec.AXES]) for v in ("v0", "v1", "v2")})
    pts = cloud.sample_surface(tri, _FULL, 11)
    per = pts.groupBy("mesh_id", "tri_id").agg(F.count(F.lit(1)).alias("got"))
    area = mesh.with_faces(tri).select("mesh_id", "tri_id", "area")
    total = area.groupBy("mesh_id").agg(F.sum("area").alias("total"))
    j = spread_join(area, total, ["mesh_id"]).join(per.hint("merge"), ["mesh_id", "tri_id"], "left")
    off = F.abs(F.coalesce("got", F.lit(0)) - F.col("area") / F.col("total") * _FULL)
    ok = j.groupBy("mesh_id").agg(F.bool_and(off < 2).alias("follows_area"), F.round(F.log(F.max("total")), 6).alias("log_area"))
    return _indices(pts, _FULL).join(ok.hint("merge"), "mesh_id")


@query("cloud_sample_on_surface", f"WITH {TRI} SELECT mesh_id, {_N}::BIGINT AS n_on_face FROM tri GROUP BY 1")
def cloud_sample_on_surface(t):
    """Every sampled point lies in the plane of its triangle."""
    tri = mesh.with_faces(meshes(t.part))
    p = cloud.sample_surface(meshes(t.part), _N, 11).join(tri.select("mesh_id", "tri_id", "v0", "normal").hint("merge"), ["mesh_id", "tri_id"])
    gap = vec.dot(vec.sub(F.struct("x", "y", "z"), F.col("v0")), F.col("normal"))
    return p.groupBy("mesh_id").agg(F.count_if(F.abs(gap) < 1e-9).alias("n_on_face"))


@query("cloud_augment", _PTS + " SELECT mesh_id, c.copy AS copy, count(*) AS n_points, true AS unit_box FROM nb, (VALUES (0), (1), (2)) c(copy) GROUP BY 1, 2")
def cloud_augment(t):
    base = cloud.to_unit_box(_corners(t))
    turned = cloud.augment(base, cloud.rotations(dealt(t.part).select(F.col("p_partkey").alias("mesh_id")), 2, 3))
    out = cloud.cloud_check(turned, ["mesh_id", "copy"])
    return out.select("mesh_id", "copy", "n_points", F.col("ok").alias("unit_box"))


@query("cloud_seed_probe", "SELECT p_partkey AS mesh_id, s.seed AS seed, s.seed = 5 AS reproduced FROM part, (VALUES (4), (5)) s(seed)")
def cloud_seed_probe(t):
    tri = meshes(t.part)
    stored = cloud.to_unit_box(cloud.sample_surface(tri, _N, 5, many=True), most=_N)
    return cloud.seed_probe(stored, tri, _N, [4, 5]).select("mesh_id", "seed", "reproduced")


@query("cloud_jitter", _PTS + " SELECT mesh_id, count(*) AS n_points, true AS bounded FROM nb GROUP BY 1")
def cloud_jitter(t):
    j = cloud.jitter(_corners(t).withColumns({f"was_{a}": F.col(a) for a in vec.AXES}), 0.01, 9)
    gap = F.greatest(*[F.abs(F.col(a) - F.col(f"was_{a}")) for a in vec.AXES])
    return j.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_points"), ((F.max(gap) < 0.09) & (F.max(gap) > 0)).alias("bounded"))


@query("augmented_rows", """WITH o AS (SELECT p_partkey, p_partkey % 9 = 0 AS gone, 8.0 + p_size * 0.1 AS a1, 9.0 + p_partkey % 5 AS a2, 2.0 + p_partkey % 3 * 0.4 AS b12, 3.0 + p_partkey % 6 * 0.2 AS g4, 2.5 + p_size * 0.03 AS g5, p_retailprice AS vf FROM part)
SELECT p_partkey AS mesh_id, copy, CASE WHEN NOT gone THEN round((CASE WHEN copy % 2 = 0 THEN a1 ELSE a2 END)::DOUBLE / 10, 8) END AS "C11_n", CASE WHEN NOT gone THEN round(b12::DOUBLE / 10, 8) END AS "C12_n",
 CASE WHEN NOT gone THEN round((CASE WHEN copy % 2 = 0 THEN g4 ELSE g5 END)::DOUBLE / 10, 8) END AS "C44_n", vf, true AS same_shape FROM o, range(4) r(copy)""")
def augmented_rows(t):
    """Quarter turns of every mesh, its tensor and labels: C11 and C44 change places with C22 and C55, the shape of the cloud stays."""
    quarter = {0: (1, 0, 0, 1), 1: (0, -1, 1, 0), 2: (-1, 0, 0, -1), 3: (0, 1, -1, 0)}
    turns = t.part.select(F.col("p_partkey").alias("mesh_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("copy"), F.array(*[F.lit(float(v)) for v in (a, b, 0, c, d, 0, 0, 0, 1)]).alias("r")) for k, (a, b, c, d) in quarter.items()])).alias("q"))
    turns = turns.select("mesh_id", "q.copy", "q.r")
    points = meshes(t.part).select("mesh_id", F.col("tri_id").alias("i"), "v0.x", "v0.y", "v0.z")
    rows = _ortho(t, F.col("p_retailprice").alias("vf")).withColumnRenamed("p_partkey", "mesh_id")
    rows = rows.withColumns({"c": F.when(F.col("mesh_id") % 9 != 0, F.col("c")), **{n: F.lit(0.5) for n in ("C11_n", "C12_n", "C44_n", "TAI")}})
    out = augmented.augmented_rows(points, rows, turns, ["C11_n", "C12_n", "C44_n", "vf"], 10.0)
    first = F.get("cloud", F.lit(0))
    spread = F.aggregate("cloud", F.lit(0.0), lambda acc, p: acc + F.sqrt(sum(((p[a] - first[a]) * (p[a] - first[a]) for a in "xy"), (p["z"] - first["z"]) * (p["z"] - first["z"]))))
    same = F.max(spread).over(Window.partitionBy("mesh_id")) - F.min(spread).over(Window.partitionBy("mesh_id")) < 1e-6
    return out.withColumn("same_shape", same).select("mesh_id", "copy", *[F.round(n, 8).alias(n) for n in ("C11_n", "C12_n", "C44_n")], "vf", "same_shape")
