"""Augmented training rows: one rotation per mesh and copy turns the cloud, the tensor and the labels that depend on the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions import tensor
from trabecula.functions.core import spread_join
from trabecula.operators import cloud


def turned_labels(rows: DataFrame, turns: DataFrame, targets: list[str], es_gpa: float, c: str = "c", tai: str | Column = "TAI", key: str = "mesh_id") -> DataFrame:
    """`rows` for every copy with the turned tensor and targets. Without a tensor the frame-dependent targets are null."""
    j = spread_join(rows, turns, [key]).withColumn("__has", F.col(c).isNotNull())
    j = j.withColumn(c, F.when(F.col("__has"), tensor.rotate(c, "r")))
    return j.withColumns({t: tensor.frame_label(t, c, es_gpa, t, tai, "__has") for t in targets}).drop("__has")


def augmented_rows(points: DataFrame, rows: DataFrame, turns: DataFrame, targets: list[str], es_gpa: float, c: str = "c", tai: str | Column = "TAI", key: str = "mesh_id") -> DataFrame:
    """G21 with F14, F15: one row per mesh and copy: the turned cloud (array of points in order of i), tensor and targets, all by the rotation `r` of `turns`.

    The rotations are shared, so a cloud never goes with labels of another frame. A cloud has a bounded number of points.
    """
    cloud_rows = cloud.augment(points, turns, key).groupBy(key, "copy").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("cloud"))
    return spread_join(turned_labels(rows, turns, targets, es_gpa, c, tai, key), cloud_rows, [key, "copy"], "left")
