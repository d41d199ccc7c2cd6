import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import CUBE, moved, sphere, torus, triangles
from trabecula.operators import cloud, mesh, walls
from trabecula.operators.score import weighted_mean


@pytest.fixture(scope="module")
def shapes(spark):
    flipped = [(CUBE[0][0], CUBE[0][2], CUBE[0][1])] + CUBE[1:]
    return triangles(spark, cube=CUBE, two=CUBE + moved(CUBE, 5), open=CUBE[:-1], flipped=flipped)


def by_mesh(df):
    return {r["mesh_id"]: r for r in df.collect()}


def test_health_of_simple_meshes(shapes):
    r = by_mesh(mesh.report(shapes))
    assert r["cube"]["volume"] == pytest.approx(1) and r["cube"]["area"] == pytest.approx(6)
    assert (r["cube"]["euler"], r["cube"]["bodies"], r["cube"]["watertight"], r["cube"]["winding_ok"]) == (2, 1, True, True)
    assert (r["two"]["euler"], r["two"]["bodies"]) == (4, 2)
    assert not r["open"]["watertight"] and r["open"]["bodies"] == 1
    assert r["flipped"]["watertight"] and not r["flipped"]["winding_ok"]


def test_nominal_cell_basis(shapes):
    r = by_mesh(mesh.measures(shapes, cell=2.0))
    assert r["cube"]["vf"] == pytest.approx(1 / 8) and r["cube"]["vf_basis"] == "nominal cell"


def test_sphere_and_torus_curvature(spark):
    tri = triangles(spark, sphere=sphere(5.0), torus=torus(10.0, 3.0)).cache()
    v, e = mesh.vertex_table(tri), mesh.edge_curvature(tri)
    k = {r["mesh_id"]: r for r in v.groupBy("mesh_id").agg(F.sum(F.col("gauss") * F.col("dual")).alias("total"), weighted_mean("gauss", "dual").alias("k"),
                                                           weighted_mean("mean_cot", "dual").alias("h")).collect()}
    h = {r["mesh_id"]: r["h"] for r in e.groupBy("mesh_id").agg(weighted_mean("mean", "weight").alias("h")).collect()}
    assert k["sphere"]["total"] == pytest.approx(4 * math.pi, rel=1e-9)
    assert k["torus"]["total"] == pytest.approx(0, abs=1e-6)
    assert k["sphere"]["k"] == pytest.approx(1 / 25, rel=0.02)
    assert h["sphere"] == pytest.approx(0.2, rel=0.02) and k["sphere"]["h"] == pytest.approx(0.2, rel=0.02)
    assert h["torus"] == pytest.approx(1 / 6, rel=0.02)
    g9 = mesh.vertex_mean_curvature(tri).where("mesh_id = 'sphere'").agg(weighted_mean("mean_dihedral", "dual").alias("h")).first()["h"]
    assert g9 == pytest.approx(0.2, rel=0.02)


def test_components_of_a_long_strip(spark):
    """A chain of triangles is the slow case for label spreading."""
    strip = [((i, 0, 0), (i + 1, 0, 0), (i, 1, 0)) for i in range(0, 60)]
    tri = triangles(spark, strip=strip, gaps=[t for i, t in enumerate(strip) if i % 4 == 0])
    b = by_mesh(mesh.bodies(tri))
    assert b["strip"]["bodies"] == 1 and b["gaps"]["bodies"] == 15


def test_meshes_in_one_chunk_need_no_rounds(spark, shapes, monkeypatch):
    """Edges that lie together are contracted where they lie; a mesh that chunks share goes on by rounds, to the same stars."""
    strip = [((i, 0, 0), (i + 1, 0, 0), (i, 1, 0)) for i in range(0, 60)]
    tri = shapes.unionByName(triangles(spark, strip=strip)).repartition(3)
    shared = {tuple(r) for r in mesh.components(tri, chunk_edges=1).collect()}
    monkeypatch.setattr(mesh, "_large_star", lambda e: pytest.fail("a round of its own"))
    assert {tuple(r) for r in mesh.components(tri.coalesce(1)).collect()} == shared
    assert len([r for r in shared if r[0] == "strip"]) == 120


def test_wall_thickness_between_plates(spark):
    def plate(z, up, n=6):
        out = []
        for i in range(n):
            for j in range(n):
                a, b, c, d = (i, j, z), (i + 1, j, z), (i + 1, j + 1, z), (i, j + 1, z)
                out += [(a, b, c), (a, c, d)] if up else [(a, c, b), (a, d, c)]
        return out
    tri = triangles(spark, slab=plate(0.7, True) + plate(0.0, False))
    for cell_rows in (4, 32, 1000):
        hits = mesh.wall_hits(tri, 3.0, 1000, 1, skin=None, cell_rows=cell_rows)
        d = [r["distance"] for r in hits.collect()]
        assert len(d) == 98 and all(x == pytest.approx(0.7) for x in d)
    s = mesh.wall_summary(hits, None, 2.0, 10).first()
    assert s["thickness_med_mm"] == pytest.approx(0.7) and s["thickness_ratio"] is None
    assert mesh.wall_summary(hits, None, 2.0, 500).first()["thickness_med_mm"] is None


def test_wall_search_equals_all_pairs(spark):
    """Uneven meshes with a dense spot: every distance as found by looking at all pairs, with few vertices met."""
    dense = [tuple((0.02 * x, 0.02 * y, 0.02 * z - 2.0) for x, y, z in t) for t in sphere(1.0, 24, 12)]
    tri = triangles(spark, ring=torus(3.0, 1.0, 48, 24), ball=sphere(2.0, 32, 16) + dense, cube=CUBE)
    v = {}
    for r in mesh.vertex_table(tri).collect():
        v.setdefault(r["mesh_id"], []).append((tuple(r["vertex"]), np.array(list(r["pos"])), np.array(list(r["normal"]))))
    for cell_rows, cap in ((4, 5.0), (32, 2.5)):
        got = {(r["mesh_id"], tuple(r["vertex"])): r["distance"] for r in mesh.wall_hits(tri, cap, skin=None, cell_rows=cell_rows).collect()}
        assert len(got) == sum(map(len, v.values()))
        for m, rows in v.items():
            pos, normal = np.array([p for _, p, _ in rows]), np.array([n for _, _, n in rows])
            for key, p, n in rows:
                gap = pos - p
                d = np.linalg.norm(gap, axis=1)
                ok = (d > 1e-3) & (d <= cap) & (-gap @ n > d * 0.6) & (normal @ n < -0.3)
                assert got[m, key] == (pytest.approx(d[ok].min()) if ok.any() else None), (m, key)


@pytest.mark.parametrize("n_samples", [None, 3])
def test_small_meshes_meet_without_a_tree(spark, monkeypatch, n_samples):
    """Vertices of small meshes meet where they lie, over the borders of batches and with null ids, to the distances of the tree."""
    cubes = triangles(spark, a=CUBE, b=moved(CUBE, 5), c=moved(CUBE, 0.5))
    tri = cubes.unionByName(cubes.where("mesh_id = 'c'").withColumn("mesh_id", F.lit(None).cast("string")))
    def found(cell_rows, cap):
        return {(r["mesh_id"], tuple(r["vertex"])): r["distance"] for r in mesh.wall_hits(tri, cap, n_samples, 1, skin=None, cell_rows=cell_rows).collect()}
    tree = {cap: found(4, cap) for cap in (0.5, 3.0)}
    assert len(tree[3.0]) == 4 * (n_samples or 8) and any(tree[3.0].values()) and not any(tree[0.5].values())
    monkeypatch.setattr(walls, "cell_tree", lambda v: pytest.fail("a tree for a mesh of one cell"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {cap: found(32, cap) for cap in tree} == tree
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wall_search_meets_few_vertices_of_a_fine_mesh(spark):
    """A slab of a million triangles, 40 spacings thick: a search by radius would meet thousands of vertices per sample."""
    n, thick = 500, 40.0
    cell = spark.range(n * n).select((F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"), "id")
    def at(dx, dy, z):
        return F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(float(z)).alias("z"))
    def face(k, *corners):
        return F.struct((F.col("id") * 4 + k).alias("tri_id"), *[at(*c).alias(f"v{i}") for i, c in enumerate(corners)])
    up = [face(0, (0, 0, thick), (1, 0, thick), (1, 1, thick)), face(1, (0, 0, thick), (1, 1, thick), (0, 1, thick))]
    down = [face(2, (0, 0, 0), (1, 1, 0), (1, 0, 0)), face(3, (0, 0, 0), (0, 1, 0), (1, 1, 0))]
    tri = cell.select(F.lit("slab").alias("mesh_id"), F.inline(F.array(*up, *down)))
    r = mesh.wall_hits(tri, 80.0, 400, 1, skin=None).agg(F.count("distance").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max("candidates").alias("met")).first()
    assert r["n"] == 400 and r["lo"] == pytest.approx(thick) and r["hi"] == pytest.approx(thick)
    assert r["met"] < 500


def test_wall_search_with_cap_per_mesh(spark):
    far = moved(CUBE, 0)
    tri = triangles(spark, near=far, short=far)
    caps = spark.createDataFrame([("near", 3.0), ("short", 0.5)], "mesh_id string, cap double")
    hits = mesh.wall_hits(tri, caps, 100, 1, skin=None).groupBy("mesh_id").agg(F.count("distance").alias("n")).collect()
    assert {r["mesh_id"]: r["n"] for r in hits}["short"] == 0


def test_fabric_of_sphere_is_isotropic(spark):
    f = mesh.fabric(triangles(spark, s=sphere(5.0)), skin=0.0).first()
    assert f["fabric_l1"] + f["fabric_l2"] + f["fabric_l3"] == pytest.approx(1)
    assert f["fabric_DA"] == pytest.approx(1, abs=0.02)
    assert mesh.fabric(triangles(spark, c=CUBE), skin=0.0).first()["fabric_l1"] is None


def test_eigenvalues_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(50):
        a = rng.normal(size=(3, 3))
        a = a + a.T
        rows.append((float(a[0, 0]), float(a[1, 1]), float(a[2, 2]), float(a[0, 1]), float(a[0, 2]), float(a[1, 2])))
    df = spark.createDataFrame(rows, "xx double, yy double, zz double, xy double, xz double, yz double")
    for r in df.withColumn("e", mesh.symmetric_eigenvalues(*[F.col(c) for c in df.columns])).collect():
        m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
        assert np.allclose(r.e, np.linalg.eigvalsh(m)[::-1], atol=1e-9)


def test_surface_sample_is_exact_and_prefix_covers_surface(spark):
    tri = triangles(spark, cube=CUBE, ball=sphere(2.0))
    pts = cloud.sample_surface(tri, 600, 3).cache()
    n = {r["mesh_id"]: (r["n"], r["k"]) for r in pts.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("k")).collect()}
    assert n == {"cube": (600, 600), "ball": (600, 600)}
    per_face = [r["n"] for r in pts.where("mesh_id = 'cube' AND i < 120").groupBy((F.col("tri_id") / 2).cast("int")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_face) == 6 and all(abs(x - 20) <= 3 for x in per_face)


def test_samples_are_the_same_wherever_meshes_are_added_up(spark, monkeypatch):
    tri = triangles(spark, cube=CUBE, ball=sphere(2.0, 12, 6), gone=[((0, 0, 0),) * 3]).withColumn("mesh_id", F.when(F.col("mesh_id") != "cube", F.col("mesh_id")))
    wanted = sorted(cloud.sample_surface(tri, 100, 3).collect(), key=str)
    assert len(wanted) == 200 and sorted(cloud.sample_surface(tri, 100, 3, many=True).collect(), key=str) == wanted
    box = {(r.mesh_id, r.i): (r.x, r.y, r.z) for r in cloud.to_unit_box(cloud.sample_surface(tri, 100, 3)).collect()}
    monkeypatch.setattr(cloud, "BUCKET_ROWS", 12)
    assert sorted(cloud.sample_surface(tri, 100, 3, many=True).collect(), key=str) == wanted
    for most in (12, 100):  # as windows, and spread
        for r in cloud.to_unit_box(cloud.sample_surface(tri, 100, 3), most=most).collect():
            assert (r.x, r.y, r.z) == pytest.approx(box[r.mesh_id, r.i], abs=1e-12)


def test_seed_probe_names_the_seed_of_each_cloud(spark):
    tri = triangles(spark, **{n: moved(CUBE, i) for i, n in enumerate(["same", "off", "short", "long", "twice", "part", "bare", "null"])})
    tri = tri.withColumn("mesh_id", F.when(F.col("mesh_id") != "null", F.col("mesh_id")))
    pts = cloud.to_unit_box(cloud.sample_surface(tri, 40, 7)).where("mesh_id is null or mesh_id != 'bare'")
    pts = pts.withColumn("x", F.when(F.expr("mesh_id = 'off' and i = 3"), F.col("x") + 1e-3).when(F.expr("mesh_id = 'part' and i = 3"), None).otherwise(F.col("x")))
    more = pts.where("mesh_id = 'long' and i = 3").withColumn("i", F.lit(40)).unionByName(pts.where("mesh_id = 'twice' and i = 3")).unionByName(pts.where("mesh_id = 'same'").withColumn("mesh_id", F.lit("lone")))
    stored = pts.where("mesh_id is null or mesh_id != 'short' or i != 3").unionByName(more)
    got = {(r.mesh_id, r.seed): (r.reproduced, r.max_diff) for r in cloud.seed_probe(stored, tri, 40, [6, 7]).collect()}
    assert set(got) == {(m, s) for m in ["same", "off", "short", "long", "twice", "part", "bare", "lone", None] for s in (6, 7)}
    assert {k for k, v in got.items() if v[0]} == {("same", 7), (None, 7)}
    assert got["off", 7][1] == pytest.approx(1e-3) and got["short", 7][1] < 1e-12 < 0.01 < got["same", 6][1] and got["bare", 7][1] is got["lone", 7][1] is None


def test_augmented_clouds_keep_shape(spark):
    pts = cloud.to_unit_box(cloud.sample_surface(triangles(spark, cube=CUBE), 200, 3))
    turned = cloud.augment(pts, cloud.rotations(pts, 3, 5)).cache()
    assert all(r["ok"] for r in cloud.cloud_check(turned, ["mesh_id", "copy"]).collect())
    p = {(r["copy"], r["i"]): np.array([r["x"], r["y"], r["z"]]) for r in turned.collect()}
    base = np.linalg.norm(p[0, 1] - p[0, 2]) / np.linalg.norm(p[0, 3] - p[0, 4])
    for c in (1, 2, 3):
        assert np.linalg.norm(p[c, 1] - p[c, 2]) / np.linalg.norm(p[c, 3] - p[c, 4]) == pytest.approx(base)


def test_jitter_spread(spark):
    pts = spark.range(4000).select(F.lit("m").alias("mesh_id"), F.col("id").cast("int").alias("i"), *[F.lit(0.0).alias(a) for a in "xyz"])
    s = cloud.jitter(pts, 0.5, 1).agg(F.stddev("x").alias("s"), F.avg("x").alias("m"), F.corr("x", "y").alias("c")).first()
    assert s["s"] == pytest.approx(0.5, rel=0.06) and abs(s["m"]) < 0.04 and abs(s["c"]) < 0.06
