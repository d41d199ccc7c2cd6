"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import col, ratio
from trabecula.functions.gates import in_band
from trabecula.operators.link import attach_missing

MAPE_FLOOR, MIN_GROUP, CHART_FLOOR = 1e-9, 3, -2.0


def r2(y: str | Column, p: str | Column) -> Column:
    """A1: 1 - SSE / SST over the rows that have both values; null when y does not vary.

    A constant group is told by min = max, so that rounding inside the variance cannot blur it.
    """
    y, p = col(y), col(p)
    both = y.isNotNull() & p.isNotNull()
    y, e = F.when(both, y), F.when(both, (y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return F.when(F.max(y) > F.min(y), 1.0 - F.try_divide(F.sum(e), sst))


def mape(y: str | Column, p: str | Column, floor: float = MAPE_FLOOR) -> Column:
    """A2: mean absolute percentage error over rows with |y| above the floor."""
    y, p = col(y), col(p)
    return F.avg(F.when(F.abs(y) > floor, F.abs((p - y) / y))) * 100.0


def score(df: DataFrame, keys: list[str] = ("target", "model"), y: str = "y_true", p: str = "y_pred",
          min_rows: int = MIN_GROUP, floor: float = MAPE_FLOOR) -> DataFrame:
    """A3: N, R2 and MAPE per group; groups with too few rows are left out."""
    keys = list(keys)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"), r2(y, p).alias("R2"), mape(y, p, floor).alias("MAPE"))
    return out.where(F.col("N") >= min_rows)


def score_band(df: DataFrame, lo: float, hi: float, x: str = "VF", **kw) -> DataFrame:
    """Scores inside one half-open density band."""
    return score(df.where(in_band(x, lo, hi)), **kw)


def score_bands(df: DataFrame, edges: list[float], x: str = "VF", keys: list[str] = ("target", "model"), **kw) -> DataFrame:
    """Scores for many adjacent bands in one pass; `band` is the band's lower edge."""
    edges = sorted(edges)
    band = F.coalesce(*[F.when(in_band(x, a, b), F.lit(float(a))) for a, b in zip(edges, edges[1:])])
    rows = df.withColumn("band", band).where(F.col("band").isNotNull())
    return score(rows, keys=[*keys, "band"], **kw)


def fold_scores(df: DataFrame, keys: list[str] = ("run", "target", "fold"), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """A4: R2 per run, target and fold; folds need more than two rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"), r2(y, p).alias("R2")).where(F.col("N") > 2)


def seed_spread(df: DataFrame, run: str = "run", target: str = "target", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """A5: mean, range, sample sd, lowest and highest R2 over runs per target."""
    per_run = df.groupBy(target, run).agg(F.count(F.lit(1)).alias("N"), r2(y, p).alias("R2"))
    per_run = per_run.withColumn("R2", F.when(F.col("N") > 2, F.col("R2")))
    return per_run.groupBy(target).agg(
        F.count("R2").alias("n_runs"), F.avg("R2").alias("mean"), (F.max("R2") - F.min("R2")).alias("spread"),
        F.when(F.count("R2") > 1, F.stddev_samp("R2")).otherwise(0.0).alias("sd"),
        F.min("R2").alias("lo"), F.max("R2").alias("hi"))


def widest(spread: DataFrame, target: str = "target") -> DataFrame:
    """A5: the target whose scores vary most over the runs."""
    return spread.agg(F.max_by(target, "spread").alias(target), F.max("spread").alias("spread"))


def score_pivot(scores: DataFrame, models: list[str], measure: str = "R2", target: str = "target", model: str = "model") -> DataFrame:
    """One column per model. The model list is given, so no extra pass looks for it."""
    return scores.groupBy(target).pivot(model, models).agg(F.avg(measure))


def mean_scores(scores: DataFrame, keys: list[str] = ("split", "target", "model"), measure: str = "R2") -> DataFrame:
    """A36."""
    return scores.groupBy(*keys).agg(F.avg(measure).alias(f"mean_{measure}"))


def clip_flag(scores: DataFrame, measure: str = "R2", floor: float = CHART_FLOOR) -> DataFrame:
    """Values below the floor are drawn at the floor but flagged."""
    return scores.withColumns({"drawn": F.greatest(F.col(measure), F.lit(floor)), "clipped": F.col(measure) < floor})


def scheme_ratio(timings: DataFrame, slow: str, fast: str) -> DataFrame:
    """Seconds of two schemes and their ratio."""
    def pick(s):
        return F.max(F.when(F.col("scheme") == s, F.col("seconds")))
    one = timings.agg(pick(slow).alias("slow_s"), pick(fast).alias("fast_s"))
    return one.withColumn("ratio", ratio("slow_s", "fast_s"))


def label_counts(df: DataFrame, targets: list[str]) -> DataFrame:
    """Known labels per target."""
    return df.agg(*[F.count(t).alias(t) for t in targets]).unpivot([], targets, "target", "n_labels")


def label_ranges(df: DataFrame, targets: list[str]) -> DataFrame:
    """Lowest, highest, mean and population sd of each target (nulls are masked)."""
    aggs = []
    for t in targets:
        aggs += [F.count(t).alias(f"{t}__n"), F.min(t).alias(f"{t}__lo"), F.max(t).alias(f"{t}__hi"),
                 F.avg(t).alias(f"{t}__m"), F.stddev_pop(t).alias(f"{t}__s")]
    packed = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}__n").alias("n"), F.col(f"{t}__lo").cast("double").alias("lo"),
                                F.col(f"{t}__hi").cast("double").alias("hi"), F.col(f"{t}__m").alias("mean"),
                                F.col(f"{t}__s").alias("sd")) for t in targets])
    return df.agg(*aggs).select(F.inline(packed))


def tidy(frames: list[tuple[str | None, DataFrame]], key_table: DataFrame, key: str = "Run") -> DataFrame:
    """Prediction tables of different shapes as one (Run, target, model, VF, y_true, y_pred[, family])."""
    out = None
    for model, d in frames:
        d = attach_missing(d, key_table, key, ["VF", "family"])
        d = d.withColumn("model", F.lit(model)) if model else d
        keep = [c for c in (key, "target", "model", "VF", "family", "y_true", "y_pred") if c in d.columns]
        out = d.select(*keep) if out is None else out.unionByName(d.select(*keep), allowMissingColumns=True)
    return out.where(F.col("VF").isNotNull())


def weighted_mean(v: str | Column, w: str | Column) -> Column:
    """sum(v w) / sum(w) over rows with both; null when the weights do not add up to more than zero."""
    v, w = col(v), col(w)
    ok = v.isNotNull() & w.isNotNull()
    total = F.sum(F.when(ok, w))
    return F.when(total > 0, F.sum(F.when(ok, v * w)) / total)


def cancellation(v: str | Column, w: str | Column) -> Column:
    """|mean v| / mean |v|."""
    return F.try_divide(F.abs(weighted_mean(v, w)), weighted_mean(F.abs(col(v)), w))
