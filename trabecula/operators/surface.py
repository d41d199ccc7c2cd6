"""Tables behind the mesh measures: faces, half-edges joined to edges, vertices and boxes, each derived once from the triangles.

`Surface` hands them out; with `keep` they are written tables, so that all measures of a feature row share one scan of the triangles.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions import vec
from trabecula.session import written

# Weld grid and smallest area.
WELD_DIGITS = 8
TINY = 1e-12


def weld_key(v: Column | str) -> Column:
    """G1: vertex identity: the coordinates on a fine integer grid."""
    scale = 10.0 ** WELD_DIGITS
    return F.struct(*[F.rint(p * scale).cast("long").alias(a) for p, a in zip(vec.parts(v), vec.AXES)])


def with_faces(tri: DataFrame) -> DataFrame:
    """Area, unit normal and the doubled-area vector of every triangle."""
    t = tri.withColumn("cr", vec.cross(vec.sub("v1", "v0"), vec.sub("v2", "v0")))
    t = t.withColumn("twice", vec.norm("cr"))
    inv = F.when(F.col("twice") > 0, 1.0 / F.col("twice")).otherwise(F.lit(0.0))
    return t.withColumns({"area": F.col("twice") / 2.0, "normal": vec.times("cr", inv)}).drop("cr", "twice")


def corner_table(faces: DataFrame) -> DataFrame:
    """One row per triangle corner: vertex, angle, a third of the area, angle-weighted normal, cotangent pull."""
    t = faces
    for i in range(3):
        a, b, c = f"v{i}", f"v{(i + 1) % 3}", f"v{(i + 2) % 3}"
        u, w = vec.sub(b, a), vec.sub(c, a)
        size = vec.norm(vec.cross(u, w))
        t = t.withColumns({f"ang{i}": vec.angle(u, w), f"cot{i}": vec.dot(u, w) / F.greatest(size, F.lit(1e-20))})
    def corner(i):
        j, k = (i + 1) % 3, (i + 2) % 3
        pull = vec.add(vec.times(vec.sub(f"v{k}", f"v{i}"), F.col(f"cot{j}")), vec.times(vec.sub(f"v{j}", f"v{i}"), F.col(f"cot{k}")))
        return F.struct(weld_key(f"v{i}").alias("vertex"), F.col(f"v{i}").alias("pos"), F.col(f"ang{i}").alias("angle"),
                        (F.col("area") / 3.0).alias("third"), vec.times("normal", F.col(f"ang{i}")).alias("wn"), pull.alias("pull"))
    return t.select("mesh_id", "tri_id", F.inline(F.array(*[corner(i) for i in range(3)])))


def vertex_rows(faces: DataFrame) -> DataFrame:
    """Per vertex position, unit normal, dual area, Gaussian and cotangent mean curvature."""
    v = corner_table(faces).groupBy("mesh_id", "vertex").agg(
        *[F.min(F.col(f"pos.{a}")).alias(f"p{a}") for a in vec.AXES], F.sum("angle").alias("angles"),
        F.sum("third").alias("dual"), *vec.sums("wn", "n"), *vec.sums("pull", "l"))
    v = v.withColumns({"pos": vec.packed("p"), "__n": vec.packed("n"), "__l": vec.packed("l")})
    v = v.withColumn("__len", vec.norm("__n"))
    v = v.withColumn("normal", vec.times("__n", F.when(F.col("__len") > 0, 1.0 / F.col("__len")).otherwise(F.lit(0.0))))
    ok = F.col("dual") > TINY
    k = F.when(ok, (2.0 * math.pi - F.col("angles")) / F.col("dual"))
    h = F.when(ok, vec.dot("__l", "normal") / (F.col("dual") * 2.0) * -0.5)
    return v.select("mesh_id", "vertex", "pos", "normal", "dual", k.alias("gauss"), h.alias("mean_cot"))


def half_edges(faces: DataFrame) -> DataFrame:
    """One row per side of a face: its edge (lo, hi), direction, end positions, and the face's area, normal and third corner."""
    t = faces.withColumns({f"k{i}": weld_key(f"v{i}") for i in range(3)})
    def half(i):
        j, k = (i + 1) % 3, (i + 2) % 3
        swap = F.col(f"k{i}") > F.col(f"k{j}")
        return F.struct(F.least(f"k{i}", f"k{j}").alias("lo"), F.greatest(f"k{i}", f"k{j}").alias("hi"), F.when(swap | (F.col(f"k{i}") == F.col(f"k{j}")), -1).otherwise(1).alias("way"),
                        F.when(swap, F.col(f"v{j}")).otherwise(F.col(f"v{i}")).alias("p_lo"),
                        F.when(swap, F.col(f"v{i}")).otherwise(F.col(f"v{j}")).alias("p_hi"), F.col(f"v{k}").alias("opposite"))
    return t.select("mesh_id", "tri_id", "area", "normal", F.inline(F.array(*[half(i) for i in range(3)])))


def edge_rows(faces: DataFrame) -> DataFrame:
    """One row per undirected edge: faces on it, balance of their directions, end positions, their areas, the normals of the faces with the
    smallest (f) and largest (g) number and the third corner of g.

    All aggregates are over single numbers, so the faces of an edge meet in a hash aggregate, combined before the shuffle.
    """
    h = half_edges(faces)
    ends = [F.min(F.col(f"{p}.{a}")).alias(f"{p}_{a}") for p in ("p_lo", "p_hi") for a in vec.AXES]
    sides = [F.min_by(F.col(f"normal.{a}"), "tri_id").alias(f"nf_{a}") for a in vec.AXES]
    sides += [F.max_by(F.col(f"{c}.{a}"), "tri_id").alias(f"{n}_{a}") for c, n in (("normal", "ng"), ("opposite", "og")) for a in vec.AXES]
    e = h.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n_faces"), F.sum("way").alias("balance"), F.sum("area").alias("areas"), *ends, *sides)
    return e.select("mesh_id", "lo", "hi", "n_faces", "balance", "areas", *[vec.packed(f"{p}_").alias(p) for p in ("p_lo", "p_hi", "nf", "ng", "og")])


def edge_use(tri: DataFrame) -> DataFrame:
    """Undirected edges with how many faces use them and the balance of their directions, without geometry."""
    k = tri.select("mesh_id", *[weld_key(v).alias(f"k{i}") for i, v in enumerate(("v0", "v1", "v2"))])
    half = F.array(*[F.struct(F.col(f"k{i}").alias("a"), F.col(f"k{(i + 1) % 3}").alias("b")) for i in range(3)])
    e = k.select("mesh_id", F.inline(half))
    e = e.select("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"),
                 F.when(F.col("a") < F.col("b"), 1).otherwise(-1).alias("way"))
    return e.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n_faces"), F.sum("way").alias("balance"))


class Surface:
    """The tables of all meshes in `tri` (mesh_id, tri_id, v0, v1, v2). With `keep` each is written when it is first asked for."""

    def __init__(self, tri: DataFrame, keep: bool = False):
        self.tri, self.keep = tri, keep

    def _table(self, df: DataFrame) -> DataFrame:
        return written(df) if self.keep else df

    @cached_property
    def faces(self) -> DataFrame:
        return self._table(with_faces(self.tri.select("mesh_id", "tri_id", "v0", "v1", "v2")))

    @cached_property
    def vertices(self) -> DataFrame:
        return self._table(vertex_rows(self.faces))

    @cached_property
    def edges(self) -> DataFrame:
        return self._table(edge_rows(self.faces))

    @cached_property
    def edge_use(self) -> DataFrame:
        return self.edges.select("mesh_id", "lo", "hi", "n_faces", "balance") if self.keep else edge_use(self.tri)

    @cached_property
    def boxes(self) -> DataFrame:
        vs = ("v0", "v1", "v2")
        return self._table((self.faces if self.keep else self.tri).groupBy("mesh_id").agg(
            *[F.min(F.least(*[F.col(f"{v}.{a}") for v in vs])).alias(f"lo_{a}") for a in vec.AXES],
            *[F.max(F.greatest(*[F.col(f"{v}.{a}") for v in vs])).alias(f"hi_{a}") for a in vec.AXES]))


def surface(tri: DataFrame | Surface) -> Surface:
    return tri if isinstance(tri, Surface) else Surface(tri)
