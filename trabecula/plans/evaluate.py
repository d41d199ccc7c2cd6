"""Forward evaluation: folds, out-of-fold predictions, scores (entry 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions.gates import parse_holdouts
from trabecula.learn import forest
from trabecula.operators import fit, folds, score


def cross_validate(df: DataFrame, key: str, features: list[str], targets: list[str], n_folds: int, carry: list[str],
                   density: str = "VF", **kw) -> DataFrame:
    """M2, M3, M9: forest and density-only control on identical leak-free folds, as one tidy table."""
    placed = folds.apply_folds(df, key, folds.fold_map(df, key, n_folds))
    out = None
    for t in targets:
        pred = forest.out_of_fold(placed, features, t, "fold", n_folds, [*carry, density], **kw)
        long = placed.where(F.col(t).isNotNull()).withColumn("target", F.lit(t))
        control = fit.control_predictions(long, density, t, "fold", ["target"], [*carry, density]).withColumn("model", F.lit("density only"))
        both = pred.unionByName(control)
        out = both if out is None else out.unionByName(both)
    return out


def evaluate(predictions: DataFrame, models: list[str], min_rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """Score table and its target x model pivot."""
    s = score.score(predictions, ["target", "model"], min_rows=min_rows)
    return s, score.score_pivot(s, models)


def holdouts(df: DataFrame, specs: list[str], features: list[str], targets: list[str], carry: list[str], **kw) -> DataFrame | None:
    """M4: predictions of every holdout spec and target that can be evaluated."""
    out = None
    for t in targets:
        p = forest.holdout_predictions(df, features, t, parse_holdouts(specs), carry, **kw)
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out
