"""Versions, duplicates and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trabecula.functions.core import any_of, col
from trabecula.functions.names import seed_label, strip_suffix
from trabecula.operators.ordered import keep_one, running_total

UNRANKED = 99


def version_number(version: str | Column) -> Column:
    """Digits of a version text; 0 when it has none."""
    return F.coalesce(F.regexp_replace(col(version).cast("string"), r"\D", "").try_cast("int"), F.lit(0))


def latest_version(df: DataFrame, run: str = "Run", version: str = "Version", seq: str = "seq") -> DataFrame:
    """Newest row per run; the later row wins a tie. Blank run names are dropped."""
    name = F.trim(F.col(run).cast("string"))
    clean = df.withColumn(run, strip_suffix(name)).where(F.col(run) != "")
    return keep_one(clean.withColumn("__v", version_number(version)), [run], ["__v", seq], "max").drop("__v")


def seed_twins(df: DataFrame, keys: list[str], seed: str, preference: list[int], seq: str) -> DataFrame:
    """One row per geometry, by the preferred seed order; unlisted seeds come last."""
    pos = F.array_position(F.array(*[F.lit(s) for s in preference]), F.col(seed).cast("int"))
    rank = F.when(F.coalesce(pos, F.lit(0)) > 0, pos).otherwise(F.lit(UNRANKED).cast("long"))
    return keep_one(df.withColumn("__p", rank), keys, ["__p", seq]).drop("__p")


def highest_version(df: DataFrame, config: list[str], version: str = "Version", seq: str = "seq",
                    variant: str | None = None) -> DataFrame:
    """Newest row per configuration, without or with the variant in the key."""
    keys = [*([variant] if variant else []), *config]
    return keep_one(df.withColumn("__v", version_number(version)), keys, ["__v", seq], "max").drop("__v")


def distinct_results(df: DataFrame, config: list[str], signature: list[str], seq: str = "seq") -> DataFrame:
    """Drop bit-identical repeats within a configuration; keep repeats that differ."""
    return keep_one(df, [*config, *signature], [seq])


def prior_runs(master: DataFrame, run: str = "Run", status: str = "Status") -> DataFrame:
    """Usable rows per run name already in the master."""
    known = F.coalesce(F.col(status), F.lit("")).startswith("OK") & (F.coalesce(F.col(run).cast("string"), F.lit("")) != "")
    return master.where(known).groupBy(run).agg(F.count(F.lit(1)).alias("n_prior"))


def number_versions(new: DataFrame, master: DataFrame, run: str, order: list[str | Column], bucket: Column) -> DataFrame:
    """v(n+1) per run, continuing from the master. `bucket` must not decrease along `order`."""
    placed = running_total(new, [run], order, bucket, out="__pos")
    placed = placed.join(prior_runs(master, run), run, "left")
    n = (F.coalesce("n_prior", F.lit(0)) + F.col("__pos")).cast("long")
    return placed.withColumn("Version", F.concat(F.lit("v"), n.cast("string"))).drop("__pos", "n_prior")


def ranked(df: DataFrame, order: list[Column], bucket: Column | None = None, keys: list[str] = (), out: str = "rank") -> DataFrame:
    """Rank 1..n over the whole table (or per key) without one task sorting it all."""
    return running_total(df, list(keys), order, bucket, out=out)


def evenly_spaced(df: DataFrame, n: int, order: list[str | Column], bucket: Column) -> DataFrame:
    """N rows spread evenly by position (all rows when there are fewer)."""
    rows = running_total(df, [], order, bucket, out="__pos", total="__tot")
    p, last = F.col("__pos") - 1, F.col("__tot") - 1
    if n < 2:
        return rows.where(p < n).drop("__pos", "__tot")
    j = F.rint(p * (n - 1) / F.greatest(last, F.lit(1)))
    inside = any_of([(F.rint((j + d) * last / (n - 1)) == p) & (j + d >= 0) & (j + d <= n - 1) for d in (-1, 0, 1)])
    return rows.where((F.col("__tot") <= n) | inside).drop("__pos", "__tot")


def first_per_value(df: DataFrame, value: str, seq: str) -> DataFrame:
    """First row of each parameter value."""
    return keep_one(df, [value], [seq])


def unique_labels(runs: DataFrame, run: str) -> DataFrame:
    """W15: 'seed N' labels; repeats get ' (2)', ' (3)' in run order. One row per run."""
    lab = runs.select(run).distinct().withColumn("__l", seed_label(run))
    placed = running_total(lab, ["__l"], [run], None, out="__n")
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return placed.select(run, F.concat("__l", suffix).alias("label"))


def repeated_names(files: DataFrame, name: str) -> DataFrame:
    """Names that occur in more than one folder."""
    return files.groupBy(name).agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)

