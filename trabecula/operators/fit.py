"""Scaling-law fits and parameter effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trabecula.functions.core import col, null_safe_join, ratio
from trabecula.functions.gates import on_slice
from trabecula.operators.ordered import keep_one

MIN_POINTS = 3


def _with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row table, read once as a scalar subquery."""
    row = one.select(F.struct(*one.columns).alias("row")).scalar()
    return df.withColumns({c: row[c] for c in one.columns})


def power_fit(df: DataFrame, x: str, y: str, keys: list[str] = (), min_points: int = MIN_POINTS) -> DataFrame:
    """y = C x^n by least squares in logs, R2 in linear space. Keys with too few positive points drop out."""
    keys = list(keys)
    pts = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    pts = pts.where((F.col("__x") > 0) & (F.col("__y") > 0))
    lx, ly = F.log("__x"), F.log("__y")
    fit = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.regr_slope(ly, lx).alias("exponent"),
                                 F.exp(F.regr_intercept(ly, lx)).alias("coefficient"))
    fit = fit.where((F.col("n_points") >= min_points) & F.col("exponent").isNotNull())
    joined = null_safe_join(pts, fit, keys) if keys else _with_row(pts, fit).where(F.col("exponent").isNotNull())
    err = F.col("__y") - F.col("coefficient") * F.pow("__x", "exponent")
    out = joined.groupBy(*keys, "n_points", "exponent", "coefficient").agg(
        F.sum(err * err).alias("__sse"), (F.var_pop("__y") * F.count("__y")).alias("__sst"),
        (F.max("__y") > F.min("__y")).alias("__varies"))
    r2 = F.when(F.col("__varies"), 1.0 - F.try_divide("__sse", "__sst")).otherwise(F.lit(0.0))
    return out.select(*keys, "n_points", "coefficient", "exponent", r2.alias("r2"))


def property_fits(df: DataFrame, x: str, properties: list[str], keys: list[str]) -> DataFrame:
    """One power law per group and property, all properties in one aggregate."""
    long = df.select(*keys, x, *[F.col(p).cast("double").alias(p) for p in properties])
    return power_fit(long.unpivot([*keys, x], properties, "property", "value"), x, "value", [*keys, "property"])


def fit_curves(fits: DataFrame, lo: float, hi: float, points: int = 58) -> DataFrame:
    """Evenly spaced x and the fitted y for every law."""
    xs = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * F.lit((hi - lo) / (points - 1)))
    out = fits.select("*", F.posexplode(xs).alias("point", "x"))
    return out.withColumn("y_fit", F.col("coefficient") * F.pow("x", "exponent"))


def line_fit(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Straight line and its worst residual."""
    keys = list(keys)
    pts = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).dropna(subset=["__x", "__y"])
    fit = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.regr_slope("__y", "__x").alias("slope"),
                                 F.regr_intercept("__y", "__x").alias("intercept"))
    j = null_safe_join(pts, fit, keys) if keys else _with_row(pts, fit)
    resid = F.abs(F.col("slope") * F.col("__x") + F.col("intercept") - F.col("__y"))
    return j.groupBy(*keys, "n_points", "slope", "intercept").agg(F.max(resid).alias("worst_residual"))


def series(df: DataFrame, param: str, x: str, y: str) -> DataFrame:
    """(parameter, x, y) points of the chart series; rows without a positive x are left out."""
    ok = F.col(param).isNotNull() & F.col(y).isNotNull() & (F.col(x) > 0)
    return df.where(ok).select(F.col(param).alias("param"), F.col(x).alias("x"), F.col(y).alias("y"))


def slice_effects(rows: DataFrame, slices: dict[str, dict[str, float]], modulus: str, rho: str, es: float,
                  exponent: float, seq: str) -> DataFrame:
    """Per design parameter the fold change of the modulus, and what is left after density scaling."""
    ok = F.col(modulus).isNotNull() & (F.coalesce(F.col(rho), F.lit(0.0)) != 0)
    hits = [F.when(ok & on_slice(held) & F.col(p).isNotNull(),
                   F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("__v")))
            for p, held in slices.items()]
    long = rows.select(F.inline(F.array_compact(F.array(*hits))), F.col(modulus).alias("__e"), F.col(rho).alias("__r"), seq)
    out = keep_one(long, ["parameter", "__v"], [seq])
    star = (F.col("__e") / F.lit(es)) / F.pow("__r", F.lit(exponent))
    agg = out.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("lowest"), F.max("__v").alias("highest"),
        ratio(F.max("__e"), F.min("__e")).alias("fold"), ratio(F.max(star), F.min(star)).alias("residual"))
    return agg.withColumn("verdict", effect_role("parameter"))


def effect_role(parameter: str | Column) -> Column:
    """Role of a design parameter."""
    p = col(parameter)
    return (F.when(p == "Seed", "INERT").when(p == "Size_Multi", "WEAK").when(p == "Inner_Size", "STRUCTURAL")
            .otherwise("DENSITY-driving"))


def by_fold_change(effects: DataFrame) -> DataFrame:
    """T9."""
    return effects.orderBy(F.desc("fold"), "parameter")


def convergence(slice_rows: DataFrame, fit: DataFrame, size: str, modulus: str, rho: str, es: float, extra: list[str] = ()) -> DataFrame:
    """Measured over predicted modulus along the size slice; `fit` is one law."""
    law = fit.select(F.struct("coefficient", "exponent").alias("law")).scalar()
    pred = law["coefficient"] * F.pow(F.col(rho), law["exponent"]) * es
    return slice_rows.select(size, rho, modulus, *extra, pred.alias("predicted"), ratio(F.col(modulus), pred).alias("ratio"))


def control_predictions(df: DataFrame, x: str, y: str, fold: str, keys: list[str], carry: list[str]) -> DataFrame:
    """M2: density-only power law fitted without each fold, all folds from one aggregate.

    The sums of a fold are taken off the totals, so no fold needs a pass of its own.
    """
    lx, ly, ok = F.log(F.col(x)), F.log(F.col(y)), (F.col(x) > 0) & (F.col(y) > 0)
    parts = {"n": F.lit(1.0), "sx": lx, "sy": ly, "sxx": lx * lx, "sxy": lx * ly}
    per = df.groupBy(*keys, fold).agg(*[F.sum(F.when(ok, v)).alias(k) for k, v in parts.items()])
    per = per.na.fill(0.0, list(parts))
    rest = per.withColumns({f"t_{k}": F.sum(k).over(Window.partitionBy(*keys)) for k in parts})
    d = {k: F.col(f"t_{k}") - F.col(k) for k in parts}
    slope = F.try_divide(d["n"] * d["sxy"] - d["sx"] * d["sy"], d["n"] * d["sxx"] - d["sx"] * d["sx"])
    law = rest.withColumn("__slope", slope).withColumn("__icpt", F.try_divide(d["sy"] - F.col("__slope") * d["sx"], d["n"]))
    law = law.where(d["n"] >= MIN_POINTS).select(*keys, fold, "__slope", "__icpt")
    out = null_safe_join(df, law, [*keys, fold])
    pred = F.exp("__icpt") * F.pow(F.col(x), F.col("__slope"))
    return out.select(*keys, fold, *carry, F.col(y).alias("y_true"), pred.alias("y_pred"))
