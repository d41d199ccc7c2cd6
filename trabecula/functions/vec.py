"""Three-component vectors as struct<x, y, z> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def make(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def parts(v: Column | str) -> tuple[Column, Column, Column]:
    v = F.col(v) if isinstance(v, str) else v
    return v["x"], v["y"], v["z"]


def sub(a, b) -> Column:
    return make(*[p - q for p, q in zip(parts(a), parts(b))])


def add(a, b) -> Column:
    return make(*[p + q for p, q in zip(parts(a), parts(b))])


def times(a, k: Column) -> Column:
    return make(*[p * k for p in parts(a)])


def dot(a, b) -> Column:
    (x, y, z), (u, v, w) = parts(a), parts(b)
    return x * u + y * v + z * w


def cross(a, b) -> Column:
    (x, y, z), (u, v, w) = parts(a), parts(b)
    return make(y * w - z * v, z * u - x * w, x * v - y * u)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def angle(a, b) -> Column:
    """Angle between two vectors, stable for small and large angles."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def sums(v: Column | str, prefix: str) -> list[Column]:
    """Aggregates that add a vector up, component by component."""
    return [F.sum(p).alias(f"{prefix}{a}") for p, a in zip(parts(v), AXES)]


def packed(prefix: str) -> Column:
    return make(*[F.col(f"{prefix}{a}") for a in AXES])
