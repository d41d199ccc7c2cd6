"""Triangle meshes as a table (mesh_id, tri_id, v0, v1, v2 as struct<x, y, z>).

Every measure is an aggregate over triangles, corners or edges, so a mesh of any size spreads over
the cluster; per-mesh results are only joined back after pre-aggregation.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trabecula.functions import vec
from trabecula.functions.core import all_of, null_safe_join, ratio, spread_join
from trabecula.operators.ordered import exact_quantiles
from trabecula.operators.score import weighted_mean
from trabecula.operators.surface import TINY, Surface, corner_table, surface, weld_key, with_faces  # noqa: F401
from trabecula.operators.walls import wall_hits  # noqa: F401
from trabecula.session import cut_lineage, written

# Fabric limits.
NORMAL_TOL, MIN_FABRIC_FACES = 0.9, 100
#: Edges that a task contracts at once.
CHUNK_EDGES = 1 << 18


def measures(tri: DataFrame | Surface, cell: float | None = None) -> DataFrame:
    """Triangles, box, volume, area, volume fraction on the box or nominal-cell basis, surface ratios."""
    tri = _triangles(tri)
    six = vec.dot("v0", vec.cross("v1", "v2")) / 6.0
    lows = [F.min(F.least(*[F.col(f"{v}.{a}") for v in ("v0", "v1", "v2")])).alias(f"lo_{a}") for a in vec.AXES]
    highs = [F.max(F.greatest(*[F.col(f"{v}.{a}") for v in ("v0", "v1", "v2")])).alias(f"hi_{a}") for a in vec.AXES]
    area = vec.norm(vec.cross(vec.sub("v1", "v0"), vec.sub("v2", "v0"))) / 2.0
    m = tri.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_tris"), F.abs(F.sum(six)).alias("volume"),
                                   F.sum(area).alias("area"), *lows, *highs)
    for a in vec.AXES:
        m = m.withColumn(f"box_{a}", F.col(f"hi_{a}") - F.col(f"lo_{a}"))
    box = F.col("box_x") * F.col("box_y") * F.col("box_z")
    basis = F.lit(float(cell) ** 3) if cell is not None else box
    m = m.withColumns({"box_volume": box, "vf": ratio("volume", basis),
                       "vf_basis": F.lit("nominal cell" if cell is not None else "bounding box")})
    scale = F.lit(float(cell if cell is not None else 1.0))
    return m.withColumns({"SAV_x_cell": ratio("area", "volume") * scale, "rel_surface": ratio("area", "box_volume") * scale})


def _triangles(tri: DataFrame | Surface) -> DataFrame:
    """The written faces of a kept surface, or the triangles."""
    return tri if isinstance(tri, DataFrame) else tri.faces if tri.keep else tri.tri


def topology(tri: DataFrame | Surface) -> DataFrame:
    """Closed (every edge has two faces), consistently wound, Euler number V - E + F."""
    edges = surface(tri).edge_use
    per = edges.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("n_edges"), (F.count_if(F.col("n_faces") != 2) == 0).alias("watertight"),
        (F.count_if((F.col("n_faces") == 2) & (F.col("balance") != 0)) == 0).alias("winding_ok"))
    ends = edges.select("mesh_id", F.explode(F.array("lo", "hi")).alias("v")).distinct()
    verts = ends.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    faces = _triangles(tri).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_tris"))
    out = per.join(verts.hint("merge"), "mesh_id").join(faces.hint("merge"), "mesh_id")
    return out.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_tris"))


def _star_sign(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("mesh_id", "a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select("mesh_id", F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("mesh_id", "a").agg(F.min("b").alias("m"))
    j = spread_join(both, low, ["mesh_id", "a"]).where(F.col("b") > F.col("a"))
    return j.select("mesh_id", F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select("mesh_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("mesh_id", "a").agg(F.min("b").alias("m"))
    j = spread_join(down, low, ["mesh_id", "a"])
    moved = j.where(F.col("b") != F.col("m")).select("mesh_id", F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("mesh_id", "a", F.col("m").alias("b"))).distinct()


def _contracted(edges: DataFrame, chunk_edges: int) -> DataFrame:
    """(mesh_id, a, b, chunk): the edges of each chunk of a task's rows as one star per body, b the smallest vertex of a; edges without a position stay, as chunk -1."""
    names = [f"{e}{a}" for e in "ab" for a in vec.AXES]

    def run(batches):
        from pyspark import TaskContext

        chunk, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_edges:
                yield from _stars(pa.Table.from_batches(held), names, chunk)
                chunk, held, rows = chunk + 1, [], 0
        if held:
            yield from _stars(pa.Table.from_batches(held), names, chunk)

    flat = edges.select("mesh_id", *[F.col(f"{e}.{a}").alias(f"{e}{a}") for e in "ab" for a in vec.AXES])
    schema = T.StructType([*flat.schema.fields, T.StructField("chunk", T.LongType())])
    return flat.mapInArrow(run, schema).select("mesh_id", *[F.struct(*[F.col(f"{e}{a}").alias(a) for a in vec.AXES]).alias(e) for e in "ab"], "chunk")


def _stars(t: pa.Table, names: list[str], chunk: int):
    placed = reduce(pc.and_, [pc.is_valid(t[n]) for n in names])
    rest, t = t.filter(pc.invert(placed)), t.filter(placed)
    yield from rest.append_column("chunk", pa.array(np.full(rest.num_rows, -1))).to_batches()
    n = t.num_rows
    mesh = pc.dictionary_encode(t["mesh_id"].combine_chunks(), null_encoding="encode")
    keys = [np.tile(mesh.indices.to_numpy(), 2), *[np.r_[t[x].to_numpy(), t[y].to_numpy()] for x, y in zip(names[:3], names[3:])]]
    order = np.lexsort(keys[::-1])
    first = np.r_[True, np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])][:2 * n]
    vertex = np.empty(2 * n, np.int64)
    vertex[order] = np.cumsum(first) - 1
    at, root = order[first], np.arange(int(first.sum()))
    while True:
        ends = root[vertex[:n]], root[vertex[n:]]
        low, now = np.minimum(*ends), root.copy()
        for e in ends:
            np.minimum.at(now, e, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            break
        root = now
    tied = np.flatnonzero(root != np.arange(len(root)))
    a, b = at[tied], at[root[tied]]
    yield pa.RecordBatch.from_arrays([mesh.dictionary.take(pa.array(keys[0][a])), *[pa.array(k[rows]) for rows in (a, b) for k in keys[1:]], pa.array(np.full(len(tied), chunk))], names=["mesh_id", *names, "chunk"])


def components(tri: DataFrame | Surface, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """(mesh_id, a = vertex, b = smallest vertex of its body) for every vertex that is not that smallest one.

    Each task contracts its edges in chunks; a mesh whose edges lie in one chunk is done with that. Meshes that several chunks share go on by alternating
    large-star / small-star contraction; each round is checkpointed, so neither lineage nor a lost executor makes it start over.
    """
    e = surface(tri).edge_use.where(F.col("lo") != F.col("hi")).select("mesh_id", F.col("hi").alias("a"), F.col("lo").alias("b"))
    stars = written(_contracted(e, chunk_edges))
    own = stars.groupBy("mesh_id").agg(F.min("chunk").alias("__first"), F.max("chunk").alias("__last"))
    shared = written(own.where((F.col("__first") < F.col("__last")) | (F.col("__first") < 0)).select("mesh_id"))
    if shared.isEmpty():
        return stars.drop("chunk")
    e = null_safe_join(stars, shared.hint("merge"), ["mesh_id"], "left_semi").drop("chunk")
    sign = None
    while True:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _star_sign(e)
        if now == sign:
            return null_safe_join(stars, shared.hint("merge"), ["mesh_id"], "left_anti").drop("chunk").unionByName(e)
        sign = now


def bodies(tri: DataFrame | Surface) -> DataFrame:
    """Disconnected bodies per mesh: vertices less those that point to another vertex."""
    key = F.explode(F.array(*[weld_key(v) for v in ("v0", "v1", "v2")]))
    verts = _triangles(tri).select("mesh_id", key.alias("k")).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    tied = components(tri).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_tied"))
    out = verts.join(tied.hint("merge"), "mesh_id", "left")
    return out.select("mesh_id", (F.col("n_vertices") - F.coalesce("n_tied", F.lit(0))).alias("bodies"))


def report(tri: DataFrame | Surface, cell: float | None = None) -> DataFrame:
    """One health row per mesh, ready for the mesh gate."""
    return measures(tri, cell).join(topology(tri).drop("n_tris").hint("merge"), "mesh_id").join(bodies(tri).hint("merge"), "mesh_id")


def vertex_table(tri: DataFrame | Surface) -> DataFrame:
    """Per vertex position, unit normal, dual area, Gaussian and cotangent mean curvature."""
    return surface(tri).vertices


def edge_curvature(tri: DataFrame | Surface) -> DataFrame:
    """Dihedral mean curvature of edges with two faces, convex positive; weight is a third of both areas."""
    e = surface(tri).edges.where((F.col("n_faces") == 2) & (F.col("lo") != F.col("hi")))
    rise = vec.dot("nf", vec.sub("og", "p_lo"))
    e = e.withColumns({"weight": F.col("areas") / 3.0, "theta": vec.angle("nf", "ng"), "length": vec.norm(vec.sub("p_lo", "p_hi")), "sign": F.when(rise < 1e-8, 1.0).otherwise(-1.0)})
    h = F.when(F.col("weight") > TINY, F.col("sign") * 0.5 * F.col("theta") * F.col("length") / F.col("weight"))
    return e.select("mesh_id", "lo", "hi", "p_lo", "p_hi", "weight", h.alias("mean"))


def vertex_mean_curvature(tri: DataFrame | Surface) -> DataFrame:
    """Dihedral curvature spread onto vertices, weighted by area (0 where no edge contributes)."""
    tri = surface(tri)
    e = edge_curvature(tri).where(F.col("mean").isNotNull())
    ends = e.select("mesh_id", F.explode(F.array("lo", "hi")).alias("vertex"), "mean", "weight")
    h = ends.groupBy("mesh_id", "vertex").agg(weighted_mean("mean", "weight").alias("mean_dihedral"))
    return vertex_table(tri).join(h.hint("merge"), ["mesh_id", "vertex"], "left").withColumn("mean_dihedral", F.coalesce("mean_dihedral", F.lit(0.0)))


def boxes(tri: DataFrame | Surface) -> DataFrame:
    """Bounding box of each mesh."""
    return surface(tri).boxes


def interior(pos: str | Column, skin: float) -> Column:
    """Strictly inside the box less a skin; needs the columns of `boxes`."""
    tests = []
    for p, a in zip(vec.parts(pos), vec.AXES):
        lo, hi = F.col(f"lo_{a}"), F.col(f"hi_{a}")
        s = (hi - lo) * skin
        tests.append((p > lo + s) & (p < hi - s))
    return all_of(tests)


def in_domain(pos: str | Column, inner: float | Column | None, offset: float) -> Column:
    """Inside the analytic cube of side `inner` around the origin, less an offset (everything without one)."""
    if inner is None:
        return F.lit(True)
    half = (inner if isinstance(inner, Column) else F.lit(float(inner))) / 2.0 - offset
    return F.coalesce(all_of([F.abs(p) <= half for p in vec.parts(pos)]), half.isNull())


def interior_share(tri: DataFrame | Surface, skin: float) -> DataFrame:
    """Share of the vertices that are interior."""
    if isinstance(tri, Surface) and tri.keep:
        v = tri.vertices.select("mesh_id", "pos")
    else:
        v = _triangles(tri).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("pos"))
        v = v.groupBy("mesh_id", weld_key("pos").alias("vertex")).agg(*[F.min(F.col(f"pos.{a}")).alias(f"p{a}") for a in vec.AXES]).withColumn("pos", vec.packed("p"))
    v = spread_join(v, boxes(tri), ["mesh_id"])
    return v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_if(interior("pos", skin)).alias("n_interior"),
                                    F.avg(interior("pos", skin).cast("double")).alias("interior_vert_frac"))


def curvature_summary(tri: DataFrame | Surface, cell: float, skin: float | None = 0.02) -> DataFrame:
    """Area means, quartile spreads and p99 of Gaussian and mean curvature, scaled by the cell size.

    `skin=None` keeps the whole surface.
    """
    L, tri = float(cell), surface(tri)
    v = vertex_table(tri).where(F.col("gauss").isNotNull())
    e = edge_curvature(tri).where(F.col("mean").isNotNull())
    if skin is not None:
        b = boxes(tri)
        v = spread_join(v, b, ["mesh_id"]).where(interior("pos", skin))
        e = spread_join(e, b, ["mesh_id"]).where(interior("p_lo", skin) & interior("p_hi", skin))
    v, e = written(v.select("mesh_id", "gauss", "dual")), written(e.select("mesh_id", "mean", "weight"))
    out = v.groupBy("mesh_id").agg((weighted_mean("gauss", "dual") * L * L).alias("curv_gauss_mean_xL2"))
    out = out.join(e.groupBy("mesh_id").agg((weighted_mean("mean", "weight") * L).alias("curv_mean_mean_xL")).hint("merge"), "mesh_id", "full")
    # Quartiles of the values and p99 of their sizes, for both curvatures, in one quantile pass.
    def both(rows, value, kind):
        sizes = F.array(F.struct(F.lit(kind).alias("kind"), F.col(value).alias("x")), F.struct(F.lit(f"|{kind}|").alias("kind"), F.abs(F.col(value)).alias("x")))
        return rows.select("mesh_id", F.inline(sizes))
    q = exact_quantiles(both(v, "gauss", "gauss").unionByName(both(e, "mean", "mean")), ["mesh_id", "kind"], "x", [0.25, 0.75, 0.99], ["q1", "q3", "p99"], many=True)
    def pick(kind, c, unit, name):
        return F.max(F.when(F.col("kind") == kind, c) * unit).alias(name)
    q = q.groupBy("mesh_id").agg(
        pick("gauss", F.col("q3") - F.col("q1"), L * L, "curv_gauss_iqr_xL2"), pick("|gauss|", F.col("p99"), L * L, "curv_gauss_p99_xL2"),
        pick("mean", F.col("q3") - F.col("q1"), L, "curv_mean_iqr_xL"), pick("|mean|", F.col("p99"), L, "curv_mean_p99_xL"))
    return out.join(q.hint("merge"), "mesh_id", "left")


def wall_summary(hits: DataFrame, expected: DataFrame | None, cell: float, min_hits: int) -> DataFrame:
    """Median, sd, hits and ratios per mesh; measures are null when there are too few hits."""
    hits = written(hits.select("mesh_id", "distance"))
    h = hits.where(F.col("distance").isNotNull())
    agg = hits.groupBy("mesh_id").agg(F.count("distance").alias("thickness_hits"), F.stddev_pop("distance").alias("__sd"))
    out = agg.join(exact_quantiles(h, ["mesh_id"], "distance", [0.5], ["__med"], many=True).hint("merge"), "mesh_id", "left")
    out = out.join(expected.hint("merge"), "mesh_id", "left") if expected is not None else out.withColumn("expected", F.lit(None).cast("double"))
    enough = F.col("thickness_hits") > min_hits
    return out.select("mesh_id", "thickness_hits", F.when(enough, F.col("__med")).alias("thickness_med_mm"),
                      F.when(enough, F.col("__sd")).alias("thickness_std_mm"),
                      F.when(enough, F.col("__med") / float(cell)).alias("thickness_over_cell"),
                      F.when(enough, ratio("__med", "expected")).alias("thickness_ratio"))


def symmetric_eigenvalues(xx, yy, zz, xy, xz, yz) -> Column:
    """Eigenvalues of a symmetric 3x3 matrix, descending, as array<double> (closed trigonometric form)."""
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    spread = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + off * 2.0
    p = F.sqrt(spread / 6.0)
    a, b, c = (xx - q), (yy - q), (zz - q)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.greatest(F.least(F.try_divide(det, p * p * p * 2.0), F.lit(1.0)), F.lit(-1.0))
    phi = F.acos(r) / 3.0
    e1, e3 = q + p * 2.0 * F.cos(phi), q + p * 2.0 * F.cos(phi + 2.0 * math.pi / 3.0)
    return F.when(p > 0, F.array(e1, q * 3.0 - e1 - e3, e3)).otherwise(F.array(q, q, q))


def fabric(tri: DataFrame | Surface, skin: float = 0.02, axis_tol: float = NORMAL_TOL, min_faces: int = MIN_FABRIC_FACES) -> DataFrame:
    """Area-weighted orientation tensor without cut faces; null measures when too few faces are left."""
    tri = surface(tri)
    t = spread_join(tri.faces, boxes(tri), ["mesh_id"])
    keep = []
    for a in vec.AXES:
        c = (F.col(f"v0.{a}") + F.col(f"v1.{a}") + F.col(f"v2.{a}")) / 3.0
        s = (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * skin
        cut = ((c < F.col(f"lo_{a}") + s) | (c > F.col(f"hi_{a}") - s)) & (F.abs(F.col(f"normal.{a}")) > axis_tol)
        keep.append(~cut)
    t = t.withColumn("keep", all_of(keep))
    names = [("xx", "x", "x"), ("yy", "y", "y"), ("zz", "z", "z"), ("xy", "x", "y"), ("xz", "x", "z"), ("yz", "y", "z")]
    w = F.when(F.col("keep"), F.col("area"))
    agg = t.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.sum(w).alias("w"),
                                   *[F.sum(w * F.col(f"normal.{p}") * F.col(f"normal.{q}")).alias(n) for n, p, q in names])
    ok = (F.col("kept") >= min_faces) & (F.col("w") > 0)
    agg = agg.withColumns({n: F.when(ok, F.col(n) / F.col("w")) for n, _, _ in names})
    agg = agg.withColumn("ev", symmetric_eigenvalues(*[F.col(n) for n, _, _ in names]))
    agg = agg.withColumns({f"fabric_l{i + 1}": F.when(ok, F.greatest(F.get("ev", F.lit(i)), F.lit(1e-12))) for i in range(3)})
    mean = (F.col("xx") + F.col("yy") + F.col("zz")) / 3.0
    var = ((F.col("xx") - mean) ** 2 + (F.col("yy") - mean) ** 2 + (F.col("zz") - mean) ** 2) / 3.0
    return agg.select("mesh_id", "fabric_l1", "fabric_l2", "fabric_l3", ratio("fabric_l1", "fabric_l3").alias("fabric_DA"),
                      (F.col("fabric_l1") - F.col("fabric_l3")).alias("fabric_aniso"), F.col("xx").alias("normal_x"),
                      F.col("yy").alias("normal_y"), F.col("zz").alias("normal_z"), F.sqrt(var).alias("normal_spread"),
                      F.when(ok, F.col("kept") / F.col("n")).alias("fabric_kept_frac"), F.col("kept").alias("n_kept"))
