"""Inverse design: coarse search, candidate plan, ranking, final gate (entry 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions.gates import eligible, final_gate
from trabecula.operators import link, search, setops


def coarse(df: DataFrame, family: str, value: str, predicted: str, target: float, lo: float, hi: float, k: int = 10,
           tie: str = "Run") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gate 1 row, k nearest rows inside the trained range, best row per family)."""
    gate1 = search.domain_overlap(df, family, value, target)
    rows = search.rank_by_distance(df, predicted, target, F.lit(lo), F.lit(hi)).where("gate4_ok")
    return gate1, search.closest(rows, k, tie=tie), search.winners(rows, [family], tie=tie)


def target_answer(df: DataFrame, family: str, value: str, target: float, tie: str) -> DataFrame:
    """Nearest existing row per family for a target, and whether the target lies inside every family's range."""
    span = search.common_range(df, family, value)
    rows = df.withColumns({"overlap_lo": span["lo"], "overlap_hi": span["hi"]})
    rows = search.rank_by_distance(rows, value, target, "overlap_lo", "overlap_hi")
    best = search.winners(rows, [family], tie=tie)
    return best.withColumn("gate1", search.inside_common_range("overlap_lo", "overlap_hi", target))


def density_thickness_plan(centres: DataFrame, built: DataFrame, d_span: float, t_span: float, nd: int, nt: int) -> DataFrame:
    """Grid around each centre, clipped to the sampled range, less the points that exist.

    `centres` carries D, t and their sampled bounds d_lo, d_hi, t_lo, t_hi; `built` carries D and t.
    """
    d, t = link.clipped_span("D", d_span, "d_lo", "d_hi"), link.clipped_span("t", t_span, "t_lo", "t_hi")
    grid = link.parameter_grid(centres, {"plan_D": (*d, nd), "plan_t": (*t, nt)})
    grid = grid.drop("D", "t").withColumnsRenamed({"plan_D": "D", "plan_t": "t"})
    return link.novel_exact(grid, built, ["D", "t"])


def density_plan(centres: DataFrame, curve: DataFrame, built: DataFrame, span: float, step: float, keys: list[str]) -> DataFrame:
    """Densities around each centre inside the measured range, away from what exists, with their t.

    `centres` carries keys and rho; `curve` carries keys, t, vf; `built` carries keys and rho.
    """
    ends = curve.groupBy(*keys).agg(F.min("vf").alias("lo"), F.max("vf").alias("hi"))
    c = centres.join(ends, keys)
    lo, hi = F.greatest("lo", F.col("rho") - span), F.least("hi", F.col("rho") + span)
    n = F.greatest(F.lit(2), (F.rint((hi - lo) / step) + 1).cast("int"))
    line = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(lo + (hi - lo) * i / (n - 1), 4))
    plan = c.where(hi >= lo).select(*keys, F.explode(line).alias("rho")).distinct()
    fresh = link.novel_range(plan, built, "rho", step, keys)
    return link.invert_curve(fresh, "rho", curve, "t", "vf", keys)


def rank(frames: list[tuple[str, DataFrame]], value: str, target: float, secondary: str, goal: str = "min",
         density_columns: list[str] = ("p_rel", "vf")) -> tuple[DataFrame, DataFrame]:
    """(full ranking of eligible candidates, finalist per family)."""
    both = setops.union_families(frames, list(density_columns), "NEW")
    ok = both.where(eligible())
    return (search.rank_candidates(ok, value, target, secondary, goal), search.finalists(ok, "family", value, target, secondary, goal))


def verify(finalists: DataFrame, measured: DataFrame, keys: list[str], targets: list[str], tol_pct: float = 15.0) -> DataFrame:
    """(keys, target, predicted, measured, diff_pct, ok) for every target both sides know."""
    p = finalists.select(*keys, *[F.col(f"pred_{t}").cast("double").alias(t) for t in targets]).unpivot(keys, targets, "target", "predicted")
    m = measured.select(*keys, *[F.col(t).cast("double").alias(t) for t in targets]).unpivot(keys, targets, "target", "measured")
    j = p.join(m, [*keys, "target"]).withColumn("__g", final_gate("predicted", "measured", tol_pct))
    return j.select(*keys, "target", "predicted", "measured", F.col("__g.diff_pct").alias("diff_pct"), F.col("__g.ok").alias("ok"))
