"""Sinks: joined dataset, append-only master (sources/master.py), resumable appends, manifests (K1-K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import null_safe_join
from trabecula.sources.master import append_master, one_per_key, read_master  # noqa: F401


def write_dataset(df: DataFrame, path: str, order: str = "VF", fmt: str = "parquet") -> None:
    """K1: dataset sorted by density (missing first), in Parquet or CSV."""
    out = df.orderBy(F.coalesce(F.col(order).cast("double"), F.lit(0.0)))
    (out.write.mode("overwrite").option("header", True).csv(path) if fmt == "csv" else out.write.mode("overwrite").parquet(path))


def remaining(todo: DataFrame, done: DataFrame, keys: list[str] = ("topology", "file"), status: str = "status") -> DataFrame:
    """K3: what a resumed run still has to do; rows that ended in ERROR or SKIPPED are tried again."""
    ok = done.where(F.coalesce(F.col(status), F.lit("OK")).startswith("OK")).select(*keys)
    return null_safe_join(todo, ok, list(keys), "left_anti")


def write_run(df: DataFrame, root: str, stamp: str, name: str) -> str:
    """K4: results of one run in a folder of their own; returns the path."""
    path = f"{root}/{name}/run_stamp={stamp}"
    df.write.mode("overwrite").parquet(path)
    return path


def manifest(df: DataFrame, targets: list[str], density: str, **facts) -> DataFrame:
    """K5: one provenance row: rows, order-free fingerprint, label and density ranges, and given facts."""
    row_hash = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash).cast("string").alias("fingerprint"),
            F.min(density).alias("vf_min"), F.max(density).alias("vf_max")]
    for t in targets:
        aggs += [F.min(t).alias(f"{t}_min"), F.max(t).alias(f"{t}_max"), F.count(t).alias(f"{t}_n")]
    one = df.agg(*aggs)
    def pack(end):
        return F.map_from_arrays(F.array(*[F.lit(t) for t in targets]), F.array(*[F.col(f"{t}_{end}") for t in targets]))
    one = one.withColumns({"label_min": pack("min"), "label_max": pack("max"), "label_n": pack("n")})
    one = one.drop(*[f"{t}_{e}" for t in targets for e in ("min", "max", "n")])
    return one.withColumns({k: F.lit(v) for k, v in facts.items()})
