"""Nodal stress maps and yield onset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import col, null_safe_join
from trabecula.functions.units import onset
from trabecula.operators.ordered import exact_quantiles


def stress_summary(nodes: DataFrame, keys: list[str], value: str | Column = "value", unit: float = 1e-6,
                   approximate: int | None = None) -> DataFrame:
    """A10: p99, maximum and node count per map (Pa to MPa by default).

    `approximate` is the accuracy of a one-pass sketch, for callers who accept its error of 1 / accuracy ranks.
    """
    v = col(value) * unit
    if approximate:
        return nodes.groupBy(*keys).agg(F.max(v).alias("max_mpa"), F.percentile_approx(v, 0.99, approximate).alias("p99_mpa"),
                                        F.count(v).alias("n_nodes"))
    q = exact_quantiles(nodes, keys, v, [0.99], ["p99_mpa"], "n_nodes")
    return null_safe_join(nodes.groupBy(*keys).agg(F.max(v).alias("max_mpa")), q, keys)


def stress_sketches(nodes: DataFrame, keys: list[str], value: str | Column = "value", unit: float = 1e-6, size: int = 4096) -> DataFrame:
    """A10, A11 in parts: per run a KLL sketch of its values (in MPa by default), their number and largest one. Store it; runs merge in any order later."""
    v = (col(value) * unit).cast("double")
    known = nodes.where(v.isNotNull() & ~F.isnan(v))
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n_nodes"), F.max(v).alias("max_mpa"))


def sketched_quantiles(sketches: DataFrame, keys: list[str], probs: list[float], names: list[str], size: int = 4096) -> DataFrame:
    """Quantiles over the merged sketches of each key, with `rank_error`: a quantile's true rank is at most that far off (twice the sketch's 99 % bound).

    No node is read again, and a key with any number of runs merges before and after one shuffle.
    """
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("__k"), F.sum("n_nodes").alias("n_nodes"), F.max("max_mpa").alias("max_mpa"))
    got = [F.kll_sketch_get_quantile_double("__k", F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
    return merged.select(*keys, "n_nodes", "max_mpa", *got, F.lit(2 * 2.296 / size ** 0.9723).alias("rank_error"))


def quartile_spread(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """Interquartile range."""
    q = exact_quantiles(df, keys, value, [0.25, 0.75], ["q1", "q3"], "n")
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


def yield_onset(summary: DataFrame, moduli: DataFrame, keys: list[str], modulus: str, sigma_ys_mpa: float, strain: float) -> DataFrame:
    """F16: applied stress, onset and concentration per run from its p99 stress and homogenised modulus."""
    j = null_safe_join(summary, moduli, keys)
    return j.withColumn("__o", onset(modulus, "p99_mpa", sigma_ys_mpa, strain)).select(
        *keys, "n_nodes", "p99_mpa", "max_mpa", F.col("__o.applied").alias("applied_mpa"),
        F.col("__o.onset").alias("onset_mpa"), F.col("__o.scf").alias("scf"))
