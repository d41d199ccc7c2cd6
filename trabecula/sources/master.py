"""K2: append-only master of run results with commit records and a key index.

    <path>/data/commit=<id>/Batch=<b>/...      rows of one append
    <path>/keys/commit=<id>/bucket=<n>/...     its (Run, Batch) keys by hash bucket
    <path>/commits/commit=<id>/...             one record: the columns of the append and its row count

A row counts once its commit record is written, which is the last step. An append that dies before leaves files that no reader looks at, and writing the
same commit again replaces them. The columns of the master come from the records, so no file footer is merged; whether a key is known is asked of
the buckets that the new keys fall into, so the rows of the master are not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trabecula.functions.core import null_safe_join
from trabecula.operators.ordered import keep_one
from trabecula.session import written

#: Hash buckets of the key index; a bucket grows with the master, an append reads those that its keys fall into.
BUCKETS = 512
#: Tasks that share the rows of one batch when they are written.
SPREAD = 8
_RECORD = "commit string, columns string, n_rows long"


def one_per_key(df: DataFrame, keys: list[str], status: str = "Status") -> DataFrame:
    """One row per key: a usable one (status OK or none given) before any other, then the smallest status and row."""
    if status not in df.columns:
        return keep_one(df, keys, [c for c in df.columns if c not in keys] or [F.lit(1)])
    text = F.coalesce(F.col(status).cast("string"), F.lit("OK"))
    return keep_one(df, keys, [F.when(text.startswith("OK"), 0).otherwise(1), text])


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def commits(spark: SparkSession, path: str) -> list:
    """The commit records, one per append: (commit, columns, n_rows)."""
    if not _exists(spark, f"{path}/commits"):
        return []
    return sorted(spark.read.schema(_RECORD).option("recursiveFileLookup", True).json(f"{path}/commits").collect())


def columns_of(records: list) -> T.StructType:
    """All columns that any append carried, in order of first appearance; one name has one type."""
    fields: dict[str, T.StructField] = {}
    for r in records:
        for f in T.StructType.fromJson(json.loads(r["columns"])).fields:
            seen = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
            if seen.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {seen.dataType.simpleString()} in the master and {f.dataType.simpleString()} in commit {r['commit']}")
    return T.StructType(list(fields.values()))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows with every column any append ever carried; a filter on Batch reads that batch's folders only."""
    records = commits(spark, path)
    schema = columns_of(records)
    folders = [f"{path}/data/commit={r['commit']}" for r in records if r["n_rows"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def known_keys(spark: SparkSession, path: str, records: list, keys: list[str], schema: T.StructType, buckets: list[int]) -> DataFrame:
    """The committed keys of the given buckets."""
    folders = [f"{path}/keys/commit={r['commit']}" for r in records if r["n_rows"]]
    kind = T.StructType([*[schema[k] for k in keys], T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(kind).option("basePath", f"{path}/keys").parquet(*folders).where(F.col("bucket").isin(buckets)).select(*keys)


def commit_rows(rows: DataFrame, path: str, commit: str, keys: list[str] = ("Run", "Batch")) -> None:
    """Writes rows whose keys are known to be new as one commit. An interrupted one is replaced when it is written again."""
    spark, keys = rows.sparkSession, list(keys)
    spread = F.pmod(F.xxhash64(*keys), F.lit(SPREAD))  # else every task would write files of every batch
    rows.repartition(F.col("Batch"), spread).write.mode("overwrite").partitionBy("Batch").parquet(f"{path}/data/commit={commit}")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "Batch" else f.dataType, True) for f in rows.schema.fields])
    back = spark.read.schema(schema).parquet(f"{path}/data/commit={commit}") if _any_file(spark, f"{path}/data/commit={commit}") else rows.limit(0)
    marked = back.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket"))
    marked.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/commit={commit}")
    record = spark.createDataFrame([(commit, schema.json(), back.count())], _RECORD)
    record.coalesce(1).write.mode("overwrite").json(f"{path}/commits/commit={commit}")


def _any_file(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(jpath))


def append_master(df: DataFrame, path: str, keys: list[str] = ("Run", "Batch"), commit: str | None = None) -> DataFrame:
    """K2: append the rows whose key is new; stored rows are never changed. A commit name that is recorded already changes nothing. Returns the master."""
    spark, keys = df.sparkSession, list(keys)
    records, commit = commits(spark, path), commit or uuid.uuid4().hex
    if commit not in {r["commit"] for r in records}:
        fresh = written(one_per_key(df.withColumn("Batch", F.col("Batch").cast("string")), keys))
        if any(r["n_rows"] for r in records):
            met = [r[0] for r in fresh.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most BUCKETS numbers
            fresh = null_safe_join(fresh, known_keys(spark, path, records, keys, columns_of(records), met), keys, "left_anti")
        commit_rows(fresh, path, commit, keys)
    return read_master(spark, path)
