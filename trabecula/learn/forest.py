"""Forest regression on Spark ML: folds, holdouts, importances, scoring."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.functions.gates import Holdout, holdout_filter
from trabecula.session import written

MIN_TRAIN_ROWS = 10
#: Fits submitted at once; their jobs share the cluster.
FITS_AT_ONCE = 4
#: Rows that a task of a fit holds; a forest keeps a number per row and tree.
FIT_ROWS = 1 << 16


def at_once(spark: SparkSession, work: list[Callable], limit: int = FITS_AT_ONCE) -> list:
    """Results of the calls in order; each submits its Spark jobs from a thread of its own, in a pool of its own name where fair scheduling is on."""
    def pooled(k: int, call: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k}")
        return call()

    with ThreadPoolExecutor(max_workers=max(1, min(limit, len(work)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(pooled), k, call) for k, call in enumerate(work)]]


def regressor(features: list[str], label: str, trees: int = 100, seed: int = 42, depth: int = 8, scale: bool = False) -> Pipeline:
    """M1, M7: assemble (standardise with training statistics) and fit a forest."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True))
    stages.append(RandomForestRegressor(featuresCol="scaled" if scale else "raw", labelCol=label, predictionCol="y_pred",
                                        numTrees=trees, maxDepth=depth, seed=seed))
    return Pipeline(stages=stages)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The n training rows dealt to enough tasks: a fit caches what its input partitions hold, and small files come as one partition."""
    tasks = -(-n // FIT_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


def usable_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with this label and all features."""
    return df.dropna(subset=[*features, label])


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, n_folds: int, carry: list[str],
                model: str = "RF", min_train: int = 3, **kw) -> DataFrame:
    """M3: every row predicted by the model that did not see its fold. The fits run at once over one written table of the rows they share."""
    rows, out = written(usable_rows(df, features, label).select(*dict.fromkeys([*carry, fold, *features, label]))), None
    counts = {r[fold]: r["n"] for r in rows.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per fold
    wanted = [k for k in range(n_folds) if counts.get(k) and sum(counts.values()) - counts[k] >= min_train]
    fits = at_once(df.sparkSession, [lambda k=k: regressor(features, label, **kw).fit(dealt(rows.where(F.col(fold) != k), sum(counts.values()) - counts[k])) for k in wanted])
    for k, fitted in zip(wanted, fits):
        pred = fitted.transform(rows.where(F.col(fold) == k))
        pred = pred.select(*carry, fold, F.col(label).cast("double").alias("y_true"), "y_pred").withColumns(
            {"target": F.lit(label), "model": F.lit(model)})
        out = pred if out is None else out.unionByName(pred)
    if out is None:
        raise ValueError(f"no fold of {label} has enough training rows")
    return out


def holdout_predictions(df: DataFrame, features: list[str], label: str, specs: list[Holdout], carry: list[str],
                        model: str = "RF", min_train: int = MIN_TRAIN_ROWS, **kw) -> DataFrame | None:
    """M4: for each holdout spec a model trained without the rows it hides; specs that leave too little are skipped."""
    rows, out = written(usable_rows(df, features, label)), None
    masks = [(s.name, m) for s in specs if (m := holdout_filter(rows, s)) is not None]
    if not masks:
        return None
    *hidden, n_rows = rows.agg(*[F.count_if(m) for _, m in masks], F.count(F.lit(1))).first()
    wanted = [(*own, n_rows - n) for own, n in zip(masks, hidden) if n and n_rows - n >= min_train]
    fits = at_once(df.sparkSession, [lambda m=m, n=n: regressor(features, label, **kw).fit(dealt(rows.where(~m), n)) for _, m, n in wanted])
    for (name, mask, _), fitted in zip(wanted, fits):
        pred = fitted.transform(rows.where(mask))
        pred = pred.select(*carry, F.col(label).cast("double").alias("y_true"), "y_pred").withColumns(
            {"target": F.lit(label), "model": F.lit(model), "split": F.lit(name)})
        out = pred if out is None else out.unionByName(pred)
    return out


def importances(fitted: PipelineModel, features: list[str], df: DataFrame, top: int = 4) -> DataFrame:
    """The most important features of a fitted forest."""
    weights = fitted.stages[-1].featureImportances.toArray()
    order = sorted(zip(features, map(float, weights)), key=lambda p: (-p[1], p[0]))[:top]
    return df.sparkSession.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(order)], "rank int, feature string, importance double")


def score_rows(fitted: PipelineModel, df: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """A prediction per row; rows with a missing feature stay, with ok = false and what is missing."""
    missing = F.concat_ws(", ", *[F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), F.lit(f)) for f in features])
    rows = df.withColumn("detail", missing)
    good = fitted.transform(rows.where("detail = ''")).select(*key, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("detail"),
                                                              F.col("y_pred").alias("predicted"))
    bad = rows.where("detail <> ''").select(*key, F.lit(False).alias("ok"), F.concat(F.lit("missing "), "detail").alias("detail"),
                                            F.lit(None).cast("double").alias("predicted"))
    return good.unionByName(bad)
