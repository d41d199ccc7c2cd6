"""Point clouds as a table (mesh_id, i, x, y, z)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trabecula.functions import vec
from trabecula.functions.core import hash_uniform, null_safe_join, spread_join
from trabecula.functions.tensor import quaternion_rotation
from trabecula.operators.mesh import with_faces
from trabecula.operators.ordered import BUCKET_ROWS, running_total
from trabecula.session import written

# Tolerances of the cloud check and of the rebuild comparison.
CENTRE_TOL, EXTENT_LOW, EXTENT_HIGH, SAME_TOL = 1e-3, 0.999, 1.001, 1e-6
# Areas in whole units of the mesh's largest triangle over 2^32: sums stay exact and below 2^63 up to two billion triangles.
STEP, AREA_UNITS = 65536, float(1 << 32)


def _scatter_step(n: int) -> int:
    """Step near the golden section with no common factor with n: i -> (i * step) mod n visits every index."""
    a = max(1, round(n * (math.sqrt(5) - 1) / 2))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def sample_surface(tri: DataFrame, n: int, seed: int, many: bool = False) -> DataFrame:
    """N points per mesh, uniform over the surface.

    The surface is cut into n equal areas and one hashed position is drawn in each. A triangle knows from its running
    area (in whole units relative to the mesh's largest triangle, so that sums are exact at any size) which positions fall on it, so points come out of the triangle rows with no join per point. Indices are
    scattered, so that the first m points cover the whole surface too. `many` is for a great many meshes, most of few triangles (`_laid_out`).
    """
    return _drawn(_laid_out(tri, many), n, seed)


def _laid_out(tri: DataFrame, many: bool) -> DataFrame:
    """Triangles with their area in whole units, the running area up to them and that of their mesh.

    With `many`, meshes of up to BUCKET_ROWS triangles are added up whole in their task, which shuffles nothing if a mesh lies together already, and
    only larger ones are spread. The choice takes a count of the triangles, but no points.
    """
    if not many:
        return _spread_out(tri)
    large = written(tri.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS).select("mesh_id"))
    if large.isEmpty():
        return _added_up(tri)
    few, rest = (null_safe_join(tri, large, ["mesh_id"], how) for how in ("left_anti", "left_semi"))
    return _added_up(few).unionByName(_spread_out(rest))


def _share() -> Column:
    return F.coalesce(F.rint(F.try_divide(F.col("area"), F.col("__largest")) * AREA_UNITS), F.lit(0.0)).cast("long")


def _spread_out(tri: DataFrame) -> DataFrame:
    t = with_faces(tri)
    t = spread_join(t, t.groupBy("mesh_id").agg(F.max("area").alias("__largest")), ["mesh_id"])
    t = t.withColumn("share", _share()).drop("__largest")
    return running_total(t, ["mesh_id"], ["tri_id"], F.floor(F.col("tri_id") / STEP), "share", out="upto", total="total", spread=True)


def _added_up(tri: DataFrame) -> DataFrame:
    upto = Window.partitionBy("mesh_id").orderBy("tri_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = with_faces(tri).withColumn("__largest", F.max("area").over(whole)).withColumn("share", _share()).drop("__largest")
    return t.withColumns({"upto": F.sum("share").over(upto), "total": F.sum("share").over(whole)})


def _drawn(t: DataFrame, n: int, seed: int) -> DataFrame:
    """The points of meshes that are laid out."""
    low = F.col("upto") - F.col("share")
    first = F.greatest(F.floor(low / F.col("total") * n) - 1, F.lit(0))
    last = F.least(F.floor(F.col("upto") / F.col("total") * n) + 1, F.lit(n - 1))
    p = t.withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    at = (F.col("k") + hash_uniform(seed, "mesh_id", "k", F.lit("at"))) / n * F.col("total")
    end = F.col("upto") >= F.col("total")
    p = p.withColumn("__at", at).where((F.col("share") > 0) & (F.col("__at") >= low) & ((F.col("__at") < F.col("upto")) | end))
    r = F.sqrt(hash_uniform(seed, "mesh_id", "k", F.lit("r")))
    s = hash_uniform(seed, "mesh_id", "k", F.lit("s"))
    weights = (1.0 - r, r * (1.0 - s), r * s)
    xyz = [sum((F.col(f"v{i}.{a}") * w for i, w in enumerate(weights)), F.lit(0.0)).alias(a) for a in vec.AXES]
    index = ((F.col("k") * _scatter_step(n)) % n).cast("int").alias("i")
    return p.select("mesh_id", index, *xyz, "tri_id")


def to_unit_box(points: DataFrame, keys: list[str] = ("mesh_id",), most: int | None = None) -> DataFrame:
    """Centre by the mean, scale by the largest extent.

    `most` is how many points a cloud has at most, where that is known: clouds of up to BUCKET_ROWS points are added up whole in their task, which
    shuffles nothing if a cloud lies together already.
    """
    keys = list(keys)
    aggs = {**{f"m_{a}": F.avg(a) for a in vec.AXES}, **{f"{f}_{a}": g(a) for f, g in (("lo", F.min), ("hi", F.max)) for a in vec.AXES}}
    if most is not None and most <= BUCKET_ROWS:
        j = points.withColumns({name: c.over(Window.partitionBy(*keys)) for name, c in aggs.items()})
    else:
        j = spread_join(points, points.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()]), keys)
    j = j.withColumn("__e", F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in vec.AXES]))
    e = F.when(F.col("__e") > 0, F.col("__e")).otherwise(F.lit(1.0))
    return j.withColumns({a: (F.col(a) - F.col(f"m_{a}")) / e for a in vec.AXES}).drop("__e", *aggs)


def cloud_check(points: DataFrame, keys: list[str] = ("mesh_id",)) -> DataFrame:
    """Centre and extent of each cloud, and whether they are those of a unit box."""
    agg = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.greatest(*[F.abs(F.avg(a)) for a in vec.AXES]).alias("centre_off"),
        F.greatest(*[F.max(a) - F.min(a) for a in vec.AXES]).alias("extent"))
    ok = (F.col("centre_off") < CENTRE_TOL) & (F.col("extent") > EXTENT_LOW) & (F.col("extent") <= EXTENT_HIGH)
    return agg.withColumn("ok", ok)


def staleness(stored: DataFrame, n_points: int, seed: int) -> DataFrame:
    """Why a stored cloud must be rebuilt; an unknown seed is stale."""
    why = F.concat_ws("; ", F.when(~F.col("n_points").eqNullSafe(F.lit(n_points)), "n_points"),
                      F.when(F.col("seed").isNull(), "no seed recorded").when(F.col("seed") != seed, "seed"))
    return stored.withColumns({"reason": why, "stale": why != ""})


def rebuild_diff(old: DataFrame, new: DataFrame, keys: list[str] = ("mesh_id",), tol: float = SAME_TOL) -> DataFrame:
    """Largest coordinate difference per cloud, and identical | changed."""
    keys = list(keys)
    o = old.select(*keys, "i", *[F.col(a).alias(f"o_{a}") for a in vec.AXES])
    n = new.select(*keys, "i", *[F.col(a).alias(f"n_{a}") for a in vec.AXES])
    j = o.join(n.hint("merge"), [*keys, "i"], "full")
    gap = F.greatest(*[F.abs(F.col(f"o_{a}") - F.col(f"n_{a}")) for a in vec.AXES])
    lone = F.col("o_x").isNull() | F.col("n_x").isNull()
    out = j.groupBy(*keys).agg(F.max(gap).alias("max_diff"), F.count_if(lone).alias("n_unpaired"))
    same = (F.col("n_unpaired") == 0) & (F.col("max_diff") < tol)
    return out.withColumn("state", F.when(same, "identical").otherwise("changed"))


def with_density(points: DataFrame, density: DataFrame, first_n: int, key: str = "mesh_id") -> DataFrame:
    """Density as a fourth channel of the first n points."""
    return points.where(F.col("i") < first_n).join(density.hint("merge"), key)


def _turn(r: str) -> dict[str, Column]:
    m = [F.get(F.col(r), F.lit(i)) for i in range(9)]
    x, y, z = (F.col(a) for a in vec.AXES)
    return {"x": m[0] * x + m[1] * y + m[2] * z, "y": m[3] * x + m[4] * y + m[5] * z, "z": m[6] * x + m[7] * y + m[8] * z}


def rotations(meshes: DataFrame, copies: int, seed: int, key: str = "mesh_id") -> DataFrame:
    """Copy numbers per mesh with a hashed uniform rotation; copy 0 is left unturned."""
    out = meshes.select(key).distinct().withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    u = [hash_uniform(seed, key, "copy", F.lit(s)) for s in ("u1", "u2", "u3")]
    eye = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    return out.withColumn("r", F.when(F.col("copy") == 0, eye).otherwise(quaternion_rotation(*u)))


def augment(points: DataFrame, turns: DataFrame, key: str = "mesh_id") -> DataFrame:
    """Every copy of every cloud, turned, centred and scaled again."""
    j = spread_join(points, turns, [key])
    turned = _turn("r")
    j = j.withColumns({f"__{a}": c for a, c in turned.items()}).drop("x", "y", "z", "r")
    j = j.withColumnsRenamed({f"__{a}": a for a in vec.AXES})
    return to_unit_box(j, [key, "copy"])


def seed_probe(stored: DataFrame, tri: DataFrame, n: int, seeds: list[int]) -> DataFrame:
    """Which candidate seed reproduces the stored cloud of each mesh.

    A stored point and the drawn one of its index meet in one sum, which is their difference, so clouds that lie together by mesh are not shuffled. An
    index with other than one point on each side is unpaired.
    """
    laid = _laid_out(tri, many=True)
    sides = [(1, stored.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))))]
    sides += [(-1, to_unit_box(_drawn(laid, n, s), most=n).withColumn("seed", F.lit(s))) for s in seeds]
    rows = reduce(DataFrame.unionByName, [d.select("mesh_id", "seed", "i", F.lit(w).alias("side"), *[(F.col(a) * w).alias(a) for a in vec.AXES]) for w, d in sides])
    met = rows.groupBy("mesh_id", "seed", "i").agg(F.sum("side").alias("side"), F.count("x").alias("n"), *[F.abs(F.sum(a)).alias(a) for a in vec.AXES])
    paired = (F.col("side") == 0) & (F.col("n") == 2)
    out = met.groupBy("mesh_id", "seed").agg(F.max(F.when(paired, F.greatest(*vec.AXES))).alias("max_diff"), F.count_if(~paired).alias("n_unpaired"))
    return out.select("mesh_id", "seed", "max_diff", ((F.col("n_unpaired") == 0) & (F.col("max_diff") < SAME_TOL)).alias("reproduced"))


def jitter(points: DataFrame, sd: float, seed: int, keys: list[str] = ("mesh_id", "i")) -> DataFrame:
    """Gaussian noise on every coordinate, the same on every run."""
    def gauss(axis):
        u, v = hash_uniform(seed, *keys, F.lit(axis), F.lit("u")), hash_uniform(seed, *keys, F.lit(axis), F.lit("v"))
        return F.sqrt(F.log(1.0 - u) * -2.0) * F.cos(v * 2.0 * math.pi)
    return points.withColumns({a: F.col(a) + gauss(a) * sd for a in vec.AXES})

