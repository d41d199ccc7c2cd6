"""Data-quality gates over datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import col, number, ratio
from trabecula.operators.ordered import exact_quantiles

# Default tolerances, and physical bands (column, low, high, hard).
DENSITY_TOL, MIN_AGREE, THICKNESS_TOL = 0.05, 0.90, 0.05
MAX_SKEW, MIN_TRIANGLES, MIN_SKEW_ROWS = 3.0, 1000, 8
TARGET_BANDS = (
    ("E_over_Es", 0.0, 1.05, True), ("G_over_Gs", 0.0, 1.05, True), ("nu_iso", -1.0, 0.5, True),
    ("TAI", 0.0, None, True), ("C11_n", 0.0, None, True), ("C44_n", 0.0, None, True),
    ("onset_n", 0.0, None, True), ("shear_onset_n", 0.0, None, True),
    ("C11_n", None, 4.0, False), ("C44_n", None, 2.0, False), ("C12_n", -0.10, 3.0, False),
    ("TAI", None, 2.0, False), ("onset_n", None, 3.0, False), ("shear_onset_n", None, 3.0, False),
)


def agreement(df: DataFrame, a: str | Column, b: str | Column, tol: float = DENSITY_TOL, min_share: float = MIN_AGREE,
              keys: list[str] = ()) -> DataFrame:
    """Share of rows with |a/b - 1| < tol. Verdict ok | fail | nothing to compare."""
    r = ratio(a, b)
    out = df.select(*keys, r.alias("__r")).groupBy(*keys).agg(
        F.count("__r").alias("n"), F.count_if(F.abs(F.col("__r") - 1) < tol).alias("n_agree"),
        F.avg("__r").alias("mean_ratio"), F.min("__r").alias("min_ratio"), F.max("__r").alias("max_ratio"))
    share = ratio("n_agree", "n")
    verdict = F.when(F.col("n") == 0, "nothing to compare").when(share >= min_share, "ok").otherwise("fail")
    return out.withColumns({"share": share, "verdict": verdict})


def worst_rows(df: DataFrame, a: str | Column, b: str | Column, k: int = 5, tie: str = "Run") -> DataFrame:
    """The k rows whose ratio is furthest from one."""
    off = F.abs(ratio(a, b) - 1)
    return df.withColumns({"ratio": ratio(a, b), "off": off}).where(F.col("off").isNotNull()).orderBy(F.desc("off"), tie).limit(k)


def ratio_spread(df: DataFrame, keys: list[str], r: str, half_width: float = 0.10) -> DataFrame:
    """Median, range and share within +-10 % of one."""
    mid = exact_quantiles(df, keys, r, [0.5], ["median"])
    v = F.col(r)
    agg = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.avg(v.between(1 - half_width, 1 + half_width).cast("double")).alias("share_close"))
    return agg.join(mid, keys) if keys else agg.withColumn("median", mid.select("median").scalar())


def integrity(df: DataFrame, features: list[str], min_triangles: int = MIN_TRIANGLES) -> DataFrame:
    """(check, severity, n) from one pass over the table. Absent feature columns are a failure of their own."""
    have = set(df.columns)
    checks: list[tuple[str, str, Column]] = []
    for f in features:
        checks.append((f"null {f}", "fail", F.count_if(number(f).isNull())) if f in have
                      else (f"missing column {f}", "fail", F.lit(1).cast("long")))
    if "VF" in have:
        checks.append(("impossible VF", "fail", F.count_if((number("VF") <= 0) | (number("VF") >= 1))))
    if "n_tris" in have:
        checks.append(("coarse mesh", "warn", F.count_if(number("n_tris") < min_triangles)))
    if "winding_ok" in have:
        checks.append(("inconsistent winding", "fail", F.count_if(number("winding_ok") == 0)))
    one = df.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    packed = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("n"))
                       for i, (n, s, _) in enumerate(checks)])
    return one.select(F.inline(packed))


def leak_rule(df: DataFrame, tol: float = DENSITY_TOL) -> DataFrame:
    """Open meshes whose measured density still agrees are a warning, the others a failure."""
    have = {"VF", "Rho_rel"} <= set(df.columns)
    leaky = number("watertight") == 0
    agrees = F.coalesce(F.abs(ratio(number("VF"), number("Rho_rel")) - 1) < tol, F.lit(False)) if have else F.lit(False)
    one = df.agg(F.count_if(leaky & agrees).alias("n_cosmetic"), F.count_if(leaky & ~agrees).alias("n_invalid"))
    verdict = F.when(F.col("n_invalid") > 0, "fail").when(F.col("n_cosmetic") > 0, "warn").otherwise("ok")
    return one.withColumn("verdict", verdict)


def band_rules(df: DataFrame, bands=TARGET_BANDS) -> DataFrame:
    """Values outside each physical band; a hard band fails, a soft one warns. One pass."""
    use = [b for b in bands if b[0] in df.columns]
    def outside(c, lo, hi):
        v, cond = number(c), F.lit(False)
        cond = cond | (v < lo) if lo is not None else cond
        return cond | (v > hi) if hi is not None else cond
    one = df.agg(*[F.count_if(outside(c, lo, hi)).alias(f"n{i}") for i, (c, lo, hi, _) in enumerate(use)],
                 *[F.count(number(c)).alias(f"k{i}") for i, (c, *_) in enumerate(use)])
    packed = F.array(*[F.struct(
        F.lit(c).alias("target"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"),
        F.col(f"k{i}").alias("n_values"), F.col(f"n{i}").alias("n_outside"),
        F.when(F.col(f"n{i}") == 0, "ok").otherwise("fail" if hard else "warn").alias("severity"))
        for i, (c, lo, hi, hard) in enumerate(use)])
    return one.select(F.inline(packed)).where(F.col("n_values") > 0)


def _sample_skew(c: Column) -> Column:
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_report(df: DataFrame, features: list[str], max_skew: float = MAX_SKEW, min_rows: int = MIN_SKEW_ROWS) -> DataFrame:
    """Bias-corrected skew per feature, the skew of its log, and whether it is flagged. One pass."""
    use = [f for f in features if f in df.columns]
    aggs = []
    for i, f in enumerate(use):
        v = number(f)
        aggs += [F.count(v).alias(f"n{i}"), _sample_skew(v).alias(f"s{i}"), _sample_skew(F.log10(F.abs(v) + 1e-12)).alias(f"l{i}")]
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("skew"),
                                F.col(f"l{i}").alias("log_skew")) for i, f in enumerate(use)])
    out = df.agg(*aggs).select(F.inline(packed)).where(F.col("n") >= min_rows)
    return out.withColumn("flagged", F.coalesce(F.abs(F.col("skew")) > max_skew, F.lit(False)))


def cross_checks(df: DataFrame, checks: list[tuple[str, str, str, float, float]]) -> DataFrame:
    """(ratio, n, mean, n_outside) for each (our column, reference column, ratio name, lo, hi)."""
    have, aggs = set(df.columns), []
    for i, (ours, ref, _, lo, hi) in enumerate(checks):
        r = ratio(number(ours), number(ref)) if {ours, ref} <= have else F.lit(None).cast("double")
        aggs += [F.count(r).alias(f"n{i}"), F.avg(r).alias(f"m{i}"), F.count_if(~((r > lo) & (r < hi))).alias(f"o{i}")]
    packed = F.array(*[F.struct(F.lit(c[2]).alias("ratio_name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                                F.col(f"o{i}").alias("n_outside")) for i, c in enumerate(checks)])
    return df.agg(*aggs).select(F.inline(packed))


def add_ratios(df: DataFrame, checks: list[tuple[str, str, str, float, float]]) -> DataFrame:
    """The ratio columns themselves."""
    return df.withColumns({name: ratio(number(a), number(b)) for a, b, name, _, _ in checks if {a, b} <= set(df.columns)})


def drift_verdict(c11_pct: str | Column, limit: float = 1.0) -> Column:
    """Reference tensor still matches?"""
    return F.when(col(c11_pct) < limit, "confirmed").otherwise("stale")
