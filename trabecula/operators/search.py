"""Inverse search: overlap, ranking, finalists, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import all_of, col, null_safe_join, percent_diff, ratio
from trabecula.functions.gates import range_guard
from trabecula.operators.dedupe import ranked
from trabecula.operators.ordered import keep_one, neighbours

# Tie band in % of the target, rows of context, calibration points, replay and rebuild limits.
TIE_BAND, CONTEXT_ROWS, MIN_CALIBRATION, REPLAY_TOL, REBUILD_TOL = 6.6, 20, 3, 0.01, 2.0


def common_range(df: DataFrame, family: str, value: str) -> Column:
    """struct(lo, hi) in which every family has rows, as a scalar subquery."""
    per = df.groupBy(family).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return per.agg(F.struct(F.max("lo").alias("lo"), F.min("hi").alias("hi")).alias("span")).scalar()


def inside_common_range(lo: str | Column, hi: str | Column, target: float) -> Column:
    """A22 (gate 1): the ranges overlap and the target lies in the overlap."""
    lo, hi = col(lo), col(hi)
    return F.coalesce((lo < hi) & (lo <= target) & (hi >= target), F.lit(False))


def domain_overlap(df: DataFrame, family: str, value: str, target: float) -> DataFrame:
    """A22 (gate 1): range in which every family has rows, rows inside it, and whether the target is."""
    span = common_range(df, family, value)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(value).between(span["lo"], span["hi"])).alias("n_inside"))
    one = one.withColumns({"lo": span["lo"], "hi": span["hi"]})
    return one.withColumn("gate1", inside_common_range("lo", "hi", target))


def rank_by_distance(df: DataFrame, value: str, target: float, lo: str | Column, hi: str | Column) -> DataFrame:
    """Distance to the target, and whether the value lies inside the trained range."""
    return df.withColumns({"abs_err": F.abs(F.col(value) - target), "gate4_ok": range_guard(value, lo, hi)})


def closest(df: DataFrame, k: int, err: str = "abs_err", tie: str = "Run") -> DataFrame:
    """The k best rows."""
    return df.where(F.col(err).isNotNull()).orderBy(err, tie).limit(k)


def winners(df: DataFrame, keys: list[str], err: str = "abs_err", tie: str = "Run") -> DataFrame:
    """The best row of each family (keys) with a known distance."""
    return keep_one(df.where(F.col(err).isNotNull()), keys, [err, tie])


def tie_order(df: DataFrame, value: str, target: float, secondary: str, goal: str = "min",
              band_pct: float = TIE_BAND) -> DataFrame:
    """off_pct and in_band, plus the sort key: inside the band by the second objective, outside by distance."""
    off = F.abs(F.col(value) - target) / target * 100.0
    df = df.withColumn("off_pct", off).withColumn("in_band", F.coalesce(F.col("off_pct") <= band_pct, F.lit(False)))
    second = F.col(secondary).cast("double") * (1.0 if goal == "min" else -1.0)
    key = F.when(F.col("in_band"), second).otherwise(F.col("off_pct"))
    return df.withColumn("__k", key).withColumn("__g", F.when(F.col("in_band"), 0).otherwise(1) * 2 + F.col("__k").isNull().cast("int"))


def rank_candidates(df: DataFrame, value: str, target: float, secondary: str, goal: str = "min",
                    band_pct: float = TIE_BAND, keys: list[str] = (), tie: str = "stem") -> DataFrame:
    """Full ranking 1..n over the table (or per key)."""
    rows = tie_order(df, value, target, secondary, goal, band_pct)
    return ranked(rows, [F.col("__g"), F.col("__k"), F.col(tie)], keys=list(keys)).drop("__g", "__k")


def top_candidates(df: DataFrame, k: int, value: str, target: float, secondary: str, goal: str = "min",
                   band_pct: float = TIE_BAND, tie: str = "stem") -> DataFrame:
    """Only the k best, without ranking the rest."""
    rows = tie_order(df, value, target, secondary, goal, band_pct)
    return rows.orderBy("__g", "__k", tie).limit(k).drop("__g", "__k")


def finalists(df: DataFrame, family: str, value: str, target: float, secondary: str, goal: str = "min",
              band_pct: float = TIE_BAND, tie: str = "stem") -> DataFrame:
    """T4: best candidate of each family under the tie-band rule."""
    rows = tie_order(df, value, target, secondary, goal, band_pct)
    return keep_one(rows, [family], ["__g", "__k", tie]).drop("__g", "__k")


def trade_off(final: DataFrame, family: str, a: str, b: str, measures: list[str]) -> DataFrame:
    """T5: one row with each measure of family a, of family b, and the difference in % of b."""
    aggs = [F.max(F.when(F.col(family) == f, F.col(m))).alias(f"{m}_{side}") for m in measures for f, side in ((a, "a"), (b, "b"))]
    one = final.agg(*aggs)
    return one.withColumns({f"{m}_diff_pct": percent_diff(f"{m}_a", f"{m}_b") for m in measures})


def context_rows(existing: DataFrame, value: str, target: float, k: int = CONTEXT_ROWS, tie: str = "Run") -> DataFrame:
    """Nearest existing rows, for comparison only and never eligible."""
    rows = existing.withColumn("off_pct", F.abs(F.col(value) - target) / target * 100.0)
    rows = rows.withColumns({"source": F.lit("EXISTING"), "eligible": F.lit(False)})
    return rows.where(F.col("off_pct").isNotNull()).orderBy("off_pct", tie).limit(k)


def is_monotone(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key whether y strictly rises along x, and how many steps do not."""
    pairs = neighbours(curve, keys, [x, y], [y])
    bad = F.count_if(F.col(f"nxt.{y}") <= F.col(f"cur.{y}"))
    return pairs.groupBy(*keys).agg(bad.alias("n_bad_steps")).withColumn("monotone", F.col("n_bad_steps") == 0)


def calibration_check(curve: DataFrame, keys: list[str], source_hash: str, tolerance: float,
                      min_points: int = MIN_CALIBRATION) -> DataFrame:
    """Enough usable points, all from the expected source at the expected tolerance, and monotone."""
    ok = curve.where(F.col("ok"))
    stats = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(~F.col("source_sha1").eqNullSafe(F.lit(source_hash))).alias("n_other_source"),
        F.count_if(~F.bround("tolerance_mm", 6).eqNullSafe(F.lit(round(tolerance, 6)))).alias("n_other_tolerance"))
    out = null_safe_join(stats, is_monotone(ok, keys, "t", "vf"), keys, "left")
    good = ((F.col("n_points") >= min_points) & (F.col("n_other_source") == 0) & (F.col("n_other_tolerance") == 0)
            & F.coalesce(F.col("monotone"), F.lit(False)))
    return out.withColumn("accepted", good)


def ensemble(predictions: DataFrame, stats: DataFrame, row: list[str]) -> DataFrame:
    """Mean over seeds in standardised space, then back to label units (and out of logs)."""
    mean = predictions.groupBy(*row, "target").agg(F.avg("z").alias("__z"))
    out = null_safe_join(mean, stats.select("target", "mean", "sd", "use_log"), ["target"])
    raw = F.col("__z") * F.col("sd") + F.col("mean")
    return out.select(*row, "target", F.when(F.col("use_log"), F.pow(F.lit(10.0), raw)).otherwise(raw).alias("predicted"))


def replay_check(expected: DataFrame, actual: DataFrame, key: list[str], targets: list[str], tol: float = REPLAY_TOL) -> DataFrame:
    """M12 (gate 0): largest relative error per row against the stored predictions."""
    a = actual.select(*key, *[F.col(t).alias(f"__{t}") for t in targets])
    j = null_safe_join(expected, a, key, "left")
    errs = [F.abs(ratio(F.col(f"__{t}") - F.col(t), F.greatest(F.abs(F.col(t)), F.lit(1e-12)))) for t in targets]
    worst = F.greatest(*errs) if len(errs) > 1 else errs[0]
    return j.select(*key, worst.alias("max_rel_err"), F.coalesce(worst <= tol, F.lit(False)).alias("gate0"))


def rebuild_check(rebuilt: DataFrame, stored: DataFrame, key: list[str], measures: dict[str, str], same: list[str] = (),
                  tol_pct: float = REBUILD_TOL) -> DataFrame:
    """Percent difference per measure against the stored row, equal topology numbers, mesh gate, all-of verdict."""
    s = stored.select(*key, *[F.col(c).alias(f"__{c}") for c in {*measures.values(), *same}])
    j = null_safe_join(rebuilt, s, key, "left")
    diffs = {f"{m}_diff_pct": percent_diff(m, f"__{ref}") for m, ref in measures.items()}
    j = j.withColumns({**diffs, **{f"{c}_same": F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same}})
    gaps = [F.abs(F.col(d)) for d in diffs]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    j = j.withColumn("worst_pct", worst)
    ok = F.coalesce(F.col("worst_pct") < tol_pct, F.lit(False))
    if "gate2" in rebuilt.columns:
        ok = ok & F.coalesce(F.col("gate2"), F.lit(False))
    return j.select(*key, *diffs, *[f"{c}_same" for c in same], "worst_pct", ok.alias("verified"))


def precondition(manifest: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """The last check passed and was made with the same source, topology and tolerance."""
    same = [F.col(k).eqNullSafe(F.lit(v)) if not isinstance(v, float) else F.bround(k, 6).eqNullSafe(F.lit(round(v, 6)))
            for k, v in wanted.items()]
    why = F.concat_ws("; ", F.when(~F.coalesce(F.col("passed"), F.lit(False)), "check failed"),
                      *[F.when(~c, f"different {k}") for c, k in zip(same, wanted)])
    return manifest.withColumns({"ready": F.coalesce(F.col("passed"), F.lit(False)) & all_of(same), "reason": why})


def batch_scores(rows: DataFrame, valid: str | Column, detail: str | Column) -> DataFrame:
    """Every row stays; invalid ones carry ok = false and the reason."""
    ok = F.coalesce(col(valid), F.lit(False))
    return rows.withColumns({"ok": ok, "detail": F.when(~ok, col(detail))})
