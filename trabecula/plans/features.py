"""Feature table: triangles to one feature row per mesh (entry 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import spread_join
from trabecula.operators import mesh
from trabecula.operators.surface import Surface

#: Hits that wall measures need.
MIN_HITS = 20


def feature_table(tri: DataFrame, files: DataFrame, cell: float, cap: float | DataFrame, expected: DataFrame | None = None, skin: float | None = 0.02,
                  min_hits: int = MIN_HITS, n_samples: int | None = None, seed: int = 0) -> DataFrame:
    """One row per row of `files` (mesh_id, status) with all measures of its triangles.

    A file that is not usable keeps its status, a usable one without triangles gets ERROR; their measures are null. The triangles are scanned once:
    all measures read the written tables of one surface.
    """
    tri = Surface(tri, keep=True)
    walls = mesh.wall_summary(mesh.wall_hits(tri, cap, n_samples, seed, skin=skin), expected, cell, min_hits)
    out = files
    for part in (mesh.measures(tri, cell), mesh.topology(tri).drop("n_tris"), mesh.interior_share(tri, skin or 0.0).drop("n_vertices"), mesh.curvature_summary(tri, cell, skin), walls,
                 mesh.fabric(tri)):
        out = spread_join(out, part, ["mesh_id"], "left")
    usable = F.coalesce(F.col("status"), F.lit("OK")).startswith("OK")
    return out.withColumn("status", F.when(usable & F.col("n_tris").isNull(), "ERROR no triangles").otherwise(F.coalesce("status", F.lit("OK"))))


def still_to_do(files: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of `files` that have no finished feature row; failed and skipped ones are tried again."""
    from trabecula.sources.sinks import remaining
    return remaining(files, done, ["mesh_id"])
