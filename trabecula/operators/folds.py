"""Leak-free folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import hash_bucket, hash_order, null_safe_join
from trabecula.operators.ordered import running_total

PHASE_SCHEMA = "size long, first long, last long, folds array<int>"


def balance_phases(histogram: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Where greedy largest-first balancing puts the groups of each size, without walking over groups.

    Groups of one size s go to fold f at levels q_f, q_f + 1, ... with q_f = load_f // s, and inside a level
    in the order (load_f mod s, f). So the folds in use only change when a level reaches another q_f: at most
    n_folds stretches per size, each a repeating cycle. Returns (size, first, last, cycle) stretches.
    """
    loads, out = [0] * n_folds, []
    for size, groups in sorted(histogram, reverse=True):
        level = [l // size for l in loads]
        steps, pos, got = sorted(set(level)), 0, [0] * n_folds
        for i, q in enumerate(steps):
            cycle = sorted((f for f in range(n_folds) if level[f] <= q), key=lambda f: (loads[f] % size, f))
            room = groups - pos if i + 1 == len(steps) else min((steps[i + 1] - q) * len(cycle), groups - pos)
            if room <= 0:
                break
            out.append((size, pos, pos + room, cycle))
            rounds, left = divmod(room, len(cycle))
            for j, f in enumerate(cycle):
                got[f] += rounds + (j < left)
            pos += room
        loads = [l + g * size for l, g in zip(loads, got)]
    return out


def fold_map(df: DataFrame, key: str, n_folds: int) -> DataFrame:
    """(key, n_rows, fold). Whole groups, biggest first, into the lightest fold; ties by group name.

    Only the histogram of group sizes reaches the driver (at most sqrt(2 x rows) distinct sizes).
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    hist = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    phases = df.sparkSession.createDataFrame(balance_phases([(r["size"], r["n"]) for r in hist], n_folds), PHASE_SCHEMA)
    placed = running_total(sizes, ["size"], [key], None, out="pos")
    placed = placed.join(phases.withColumnRenamed("size", "__size"),
                         (F.col("size") == F.col("__size")) & (F.col("pos") - 1 >= F.col("first")) & (F.col("pos") - 1 < F.col("last")))
    turn = ((F.col("pos") - 1 - F.col("first")) % F.size("folds")).cast("int")
    return placed.select(key, F.col("size").alias("n_rows"), F.get("folds", turn).alias("fold"))


def row_folds(df: DataFrame, row_id: str, n_folds: int, seed: int = 42) -> DataFrame:
    """W10 without groups: every row its own group, dealt out in hash order."""
    one = df.select(row_id).distinct().withColumn("__h", hash_order(seed, row_id))
    placed = running_total(one, [], ["__h", row_id], hash_bucket("__h"), out="__pos")
    return placed.select(row_id, ((F.col("__pos") - 1) % n_folds).cast("int").alias("fold"))


def apply_folds(df: DataFrame, key: str, folds: DataFrame) -> DataFrame:
    """Fold of each row; rows of an unknown group get -1."""
    return df.join(folds.select(key, "fold"), key, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))


def stratified_holdout(df: DataFrame, stratum: str, row_id: str, fraction: float, seed: int) -> DataFrame:
    """`is_test` per row: round(n x fraction) of each stratum, at least 1, at most n - 1, none when n < 2."""
    rows = df.withColumn("__h", hash_order(seed, row_id))
    rows = running_total(rows, [stratum], ["__h", row_id], hash_bucket("__h"), out="__pos", total="__n")
    n = F.col("__n")
    want = F.when(n >= 2, F.least(F.greatest(F.rint(n * fraction), F.lit(1)), n - 1)).otherwise(F.lit(0))
    return rows.withColumn("is_test", F.col("__pos") <= want).drop("__h", "__pos", "__n")


def validation_groups(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Whole groups for validation until max(2, round(fraction x n)) rows, never the last group."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("__h", hash_order(seed, key))
    order, bucket = ["__h", key], hash_bucket("__h")
    rows = running_total(sizes, [], order, bucket, "n_rows", out="__upto", total="__rows")
    rows = running_total(rows, [], order, bucket, out="__pos", total="__groups")
    want = F.greatest(F.lit(2), F.rint(F.col("__rows") * fraction))
    take = (F.col("__upto") - F.col("n_rows") < want) & (F.col("__pos") < F.col("__groups"))
    return rows.where(take).select(key, "n_rows")


def stratum_column(df: DataFrame, wanted: str | None, fallbacks=("variant", "topology", "family")) -> str | None:
    """M6: the wanted column when the table has it, else the first fallback it has."""
    return next((c for c in ([wanted] if wanted else []) + list(fallbacks) if c in df.columns), None)


def long_targets(df: DataFrame, targets: list[str], carry: list[str]) -> DataFrame:
    """One row per known label, so that sparse targets only lose their own missing rows."""
    rows = df.select(*carry, *[F.col(t).cast("double").alias(t) for t in targets])
    return rows.unpivot(carry, targets, "target", "y_true").where(F.col("y_true").isNotNull())


def row_guards(long: DataFrame, min_rows: int, min_train: int, fold: str = "fold") -> DataFrame:
    """Per target and fold the training rows, and why a fit would be skipped."""
    per = long.groupBy("target", fold).agg(F.count(F.lit(1)).alias("n_test"))
    tot = per.groupBy("target").agg(F.sum("n_test").alias("n_target"))
    out = null_safe_join(per, tot, ["target"]).withColumn("n_train", F.col("n_target") - F.col("n_test"))
    why = F.when(F.col("n_target") < min_rows, "too few rows").when(F.col("n_train") < min_train, "too few training rows")
    return out.withColumn("skipped", why)


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows, groups, largest group and singletons."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("largest"),
                   F.count_if(F.col("n") == 1).alias("singletons"))


def miss_counts(missed: DataFrame, topology: str) -> DataFrame:
    """Unmatched rows per topology, most first."""
    return missed.groupBy(topology).agg(F.count(F.lit(1)).alias("n_missing")).orderBy(F.desc("n_missing"), topology)
