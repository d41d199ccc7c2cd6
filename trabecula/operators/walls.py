"""Wall search: the nearest opposing vertex in the inward cone of a vertex, found down a tree of cells.

Vertices get a Morton number in the box of their mesh. Cells are runs of such numbers: their size follows the mean vertex spacing of the mesh, and
cells that still hold too many vertices are split further. Each cell knows the box of its positions and the range of its normals, so whole cells are
ruled out, or known to hold a hit, before a vertex of them is met. A sample goes down the tree level by level and keeps only the cells that may hold
something nearer than what is certain already; only the vertices of the cells left at the end are met.

A mesh of one cell needs no tree: its vertices lie together in a task and meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trabecula.functions import vec
from trabecula.functions.core import all_of, hash_bucket, hash_order, null_safe_join, spread_join
from trabecula.operators.ordered import running_total
from trabecula.operators.surface import Surface, surface
from trabecula.session import written

# Cone and opposition limits of the search, smallest distance.
CONE_COS, OPPOSING_DOT, MIN_DISTANCE = 0.6, -0.3, 1e-3
#: Bits of the Morton number per axis, mean spacings along a cell, and vertices that a cell may hold.
BITS, SPACINGS, CELL_ROWS = 20, 2.5, 32
_SLACK = 1e-9
#: Pairs of vertices that a task looks at in one go.
PAIRS = 1 << 19


def _spread(n: Column) -> Column:
    """Bits of a number below 2^21 with two free bits after each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def morton(pos: str | Column) -> Column:
    """Position in the cube (lo_x, lo_y, lo_z, side) as interleaved bits."""
    code = F.lit(0).cast("long")
    for i, (p, a) in enumerate(zip(vec.parts(pos), vec.AXES)):
        cell = F.floor((p - F.col(f"lo_{a}")) / F.col("side") * float(1 << BITS))
        code = code.bitwiseOR(F.shiftleft(_spread(F.greatest(F.least(cell, F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")), i))
    return code


def _code() -> Column:
    """Number of the cell that holds a vertex at its level."""
    return F.expr(f"shiftright(morton, 3 * ({BITS} - level))")


def celled(verts: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Vertices with `morton` and `level`, the depth of their cell; written. Cells with over `cell_rows` vertices are split while the number has bits left."""
    per = verts.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dual").alias("area"), *[F.min(F.col(f"pos.{a}")).alias(f"lo_{a}") for a in vec.AXES],
                                       *[F.max(F.col(f"pos.{a}")).alias(f"hi_{a}") for a in vec.AXES])
    side = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in vec.AXES])
    per = per.withColumn("side", F.when(side > 0, side).otherwise(F.lit(1.0)))
    wanted = F.floor(F.log2(F.col("side") / (F.sqrt(F.col("area") / F.col("n")) * SPACINGS)))
    level = F.when(F.col("n") <= cell_rows, 0).otherwise(F.greatest(F.lit(0), F.least(F.coalesce(wanted, F.lit(0)), F.lit(BITS)))).cast("int")
    frames = per.select("mesh_id", "side", *[f"lo_{a}" for a in vec.AXES], level.alias("level"))
    v = written(spread_join(verts, frames, ["mesh_id"]).withColumn("morton", morton("pos")).drop("side", *[f"lo_{a}" for a in vec.AXES]))
    while True:
        full = written(v.groupBy("mesh_id", "level", _code().alias("code")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > cell_rows) & (F.col("level") < BITS)).drop("n"))
        if full.isEmpty():
            return v
        marked = spread_join(v.withColumn("code", _code()), full.withColumn("full", F.lit(True)), ["mesh_id", "level", "code"], "left")
        v = written(marked.withColumn("level", F.least(F.when(F.col("full"), F.col("level") + 2).otherwise(F.col("level")), F.lit(BITS))).drop("code", "full"))


def cell_tree(v: DataFrame) -> DataFrame:
    """One row per cell and level from the whole mesh down: whether it is a leaf, the box of its positions and the ranges of its normals; written."""
    ends = [(f, p, a, f"{n}_{p}{a}") for f, n in ((F.min, "lo"), (F.max, "hi")) for p in ("p", "n") for a in vec.AXES]
    source = {"p": "pos", "n": "normal"}
    leaves = v.groupBy("mesh_id", "level", _code().alias("code")).agg(*[f(F.col(f"{source[p]}.{a}")).alias(name) for f, p, a, name in ends])
    up = leaves.select("mesh_id", "level", "code", *[x[-1] for x in ends], F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at"))
    return written(up.groupBy("mesh_id", "at", F.expr("shiftright(code, 3 * (level - at))").alias("code")).agg(
        F.max(F.col("at") == F.col("level")).alias("leaf"), *[f(name).alias(name) for f, _, _, name in ends]))


def _corners() -> list[Column]:
    return [vec.make(*[F.col(f"{'hi' if k >> i & 1 else 'lo'}_p{a}") for i, a in enumerate(vec.AXES)]) for k in range(8)]


def _judged(rows: DataFrame) -> DataFrame:
    """Adds `near` (the least distance to the cell's box), `may` (it may hold a hit) and `sure` (the farthest distance of a certain hit, or null)."""
    def largest(weights: Column, lo: str, hi: str, origin: Column | None) -> Column:
        total = F.lit(0.0)
        for w, a in zip(vec.parts(weights), vec.AXES):
            shift = F.lit(0.0) if origin is None else vec.parts(origin)[vec.AXES.index(a)]
            total = total + F.greatest(w * (F.col(f"{lo}{a}") - shift), w * (F.col(f"{hi}{a}") - shift))
        return total

    pos, normal = F.col("pos"), F.col("normal")
    inward = vec.times(normal, F.lit(-1.0))
    gaps = [F.greatest(F.col(f"lo_p{a}") - p, p - F.col(f"hi_p{a}"), F.lit(0.0)) for p, a in zip(vec.parts(pos), vec.AXES)]
    reach = [F.greatest(F.abs(F.col(f"lo_p{a}") - p), F.abs(F.col(f"hi_p{a}") - p)) for p, a in zip(vec.parts(pos), vec.AXES)]
    near, far = (F.sqrt(sum((g * g for g in x[1:]), x[0] * x[0])) for x in (gaps, reach))
    rows = rows.withColumns({"near": near, "far": far, "ahead": largest(inward, "lo_p", "hi_p", pos), "facing": -largest(inward, "lo_n", "hi_n", None), "backing": largest(normal, "lo_n", "hi_n", None)})
    may = (F.col("near") <= F.col("bound") + _SLACK) & (F.col("far") > MIN_DISTANCE - _SLACK) & (F.col("ahead") > F.col("near") * CONE_COS - _SLACK) & (F.col("facing") < OPPOSING_DOT + _SLACK)
    inside = all_of([vec.dot(vec.sub(pos, c), "normal") > vec.norm(vec.sub(c, pos)) * CONE_COS + _SLACK for c in _corners()])
    sure = F.when((F.col("backing") < OPPOSING_DOT - _SLACK) & (F.col("near") > MIN_DISTANCE + _SLACK) & inside, F.col("far"))
    return rows.where(may).withColumn("sure", sure).drop("far", "ahead", "facing", "backing")


def wall_hits(tri: DataFrame | Surface, cap: float | DataFrame, n_samples: int | None = None, seed: int = 0, skin: float | None = 0.02, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per vertex (of `n_samples` hashed ones per mesh, if given) the distance to the nearest opposing vertex inside the inward cone (null: none).

    `cap` is one search radius or a table (mesh_id, cap). `candidates` is how many vertices were met for it. Meshes of over `cell_rows` vertices go down
    the tree: rounds are the levels of the deepest mesh; each is written, so the next starts from the cells still open.
    """
    from trabecula.operators.mesh import interior

    s = surface(tri)
    v = s.vertices.select("mesh_id", "vertex", "pos", "normal", "dual")
    v = v if s.keep else written(v)
    pool = spread_join(v, cap, ["mesh_id"]) if isinstance(cap, DataFrame) else v.withColumn("cap", F.lit(float(cap)))
    asked = F.lit(True) if skin is None else F.coalesce(interior("pos", skin), F.lit(False))
    pool = (pool if skin is None else spread_join(pool, s.boxes, ["mesh_id"])).select("mesh_id", "vertex", "pos", "normal", "cap", asked.alias("asked"))
    if n_samples is not None:
        left = pool.where("asked").select("mesh_id", "vertex", hash_order(seed, "mesh_id", "vertex").alias("__h"))
        left = running_total(left, ["mesh_id"], ["__h", "vertex"], hash_bucket("__h"), out="__pos", spread=True)
        left = left.where(F.col("__pos") <= n_samples).select("mesh_id", "vertex", F.lit(True).alias("asked"))
        pool = spread_join(pool.drop("asked"), left, ["mesh_id", "vertex"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    large = written(v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select("mesh_id"))
    if large.isEmpty():
        return _met_at_once(pool)
    few, many = (null_safe_join(pool, large.hint("merge"), ["mesh_id"], how) for how in ("left_anti", "left_semi"))
    return _met_at_once(few).unionByName(_searched(null_safe_join(v, large.hint("merge"), ["mesh_id"], "left_semi"), many.where("asked").drop("asked"), cell_rows))


def _met_at_once(pool: DataFrame) -> DataFrame:
    """Every asked vertex of small meshes meets all vertices of its mesh, which lie next to each other in a task."""
    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            mesh = _mesh_numbers(t)
            whole = int(np.searchsorted(-(mesh != mesh[-1]).astype(int), 0)) if len(mesh) else 0
            held = t.slice(whole)
            yield from _nearest(t.slice(0, whole), mesh[:whole])
        if held is not None:
            yield from _nearest(held, _mesh_numbers(held))

    schema = T.StructType([*pool.select("mesh_id", "vertex").schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("candidates", T.LongType())])
    return pool.repartition("mesh_id").sortWithinPartitions("mesh_id").mapInArrow(run, schema)


def _mesh_numbers(t: pa.Table) -> np.ndarray:
    return pc.dictionary_encode(t["mesh_id"].combine_chunks(), null_encoding="encode").indices.to_numpy() if t.num_rows else np.empty(0, np.int64)


def _nearest(t: pa.Table, mesh: np.ndarray) -> Iterator[pa.RecordBatch]:
    pos, normal = ([c.to_numpy() for c in t[name].flatten()] for name in ("pos", "normal"))
    cap, rows = t["cap"].to_numpy(), np.flatnonzero(t["asked"].to_numpy())
    if not len(rows):
        return
    first = np.flatnonzero(np.r_[True, np.diff(mesh) != 0])
    of, size = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(mesh)])), np.diff(np.r_[first, len(mesh)])
    for own in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[of[rows]]) // PAIRS)) + 1):
        n = size[of[own]]
        start = np.cumsum(n) - n
        a, b = np.repeat(own, n), np.arange(n.sum()) + np.repeat(first[of[own]] - start, n)
        gap = [p[b] - p[a] for p in pos]
        inward, opposing = (x * u + y * v + z * w for (x, y, z), (u, v, w) in ((gap, [c[a] for c in normal]), ([c[b] for c in normal], [c[a] for c in normal])))
        d = np.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
        hit = (d > MIN_DISTANCE) & (d <= cap[a]) & (-inward > d * CONE_COS) & (opposing < OPPOSING_DOT)
        nearest = np.minimum.reduceat(np.where(hit, d, np.inf), start)
        keys = t.select(["mesh_id", "vertex"]).take(pa.array(own))
        yield from keys.append_column("distance", pa.array(nearest, mask=np.isinf(nearest))).append_column("candidates", pa.array(n)).combine_chunks().to_batches()


def _searched(verts: DataFrame, left: DataFrame, cell_rows: int) -> DataFrame:
    """The vertices `left` of large meshes against the tree of their mesh's cells."""
    v, left = celled(verts, cell_rows), written(left)
    tree = cell_tree(v)
    deepest = v.agg(F.max("level")).first()[0] or 0

    own = ["mesh_id", "vertex", "pos", "normal", "cap", "bound"]
    open_cells, reached = left.withColumn("bound", F.col("cap")).withColumn("parent", F.lit(0).cast("long")), None
    for level in range(deepest + 1):
        cells = tree.where(F.col("at") == level).withColumn("parent", F.shiftright("code", 3)).drop("at")
        met = _judged(spread_join(open_cells, cells, ["mesh_id", "parent"]))
        best = F.least("bound", F.min("sure").over(Window.partitionBy("mesh_id", "vertex")))
        met = written(met.withColumn("bound", best).where(F.col("near") <= F.col("bound") + _SLACK).select(*own, "code", "leaf", F.lit(level).alias("level")))
        ready = met.where("leaf").drop("leaf")
        reached = ready if reached is None else reached.unionByName(ready)
        open_cells = met.where("not leaf").select(*own, F.col("code").alias("parent"))
    others = v.select("mesh_id", "level", _code().alias("code"), F.col("pos").alias("q"), F.col("normal").alias("qn"))
    j = spread_join(reached, others, ["mesh_id", "level", "code"])
    gap = vec.sub("q", "pos")
    d = vec.norm(gap)
    hit = (d > MIN_DISTANCE) & (d <= F.col("cap")) & (-vec.dot(gap, "normal") > d * CONE_COS) & (vec.dot("qn", "normal") < OPPOSING_DOT)
    found = j.groupBy("mesh_id", "vertex").agg(F.min(F.when(hit, d)).alias("distance"), F.count(F.lit(1)).alias("candidates"))
    out = spread_join(left.select("mesh_id", "vertex"), found, ["mesh_id", "vertex"], "left")
    return out.withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
