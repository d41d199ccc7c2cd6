"""Which runs have which files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of result file by name ending, and the bytes below which a file counts as empty.
KINDS = (("shear", "_shear_stress.csv", 20), ("compression", "_stress.csv", 20), ("STL", ".stl", 1000),
         ("outputs.json", "outputs.json", 20), ("run_info.json", "run_info.json", 2), ("C tensor", ".csv", 20))
REQUIRED = ("C tensor", "compression", "shear", "STL", "outputs.json")
RESULT_BYTES = 100


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below <root>/<batch>/Data/<run>/: batch, run, file, length. Contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    p = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    return df.select(F.element_at(p, -4).alias("Batch"), F.element_at(p, -2).alias("Run"), F.element_at(p, -1).alias("file"),
                     "length", "modificationTime", "path")


def with_kind(files: DataFrame) -> DataFrame:
    """Kind of each file; the tensor file is the CSV named after its run."""
    f = F.col("file")
    kind = F.coalesce(*[F.when((f == F.concat(F.col("Run"), F.lit(end))) | ((f == end) & F.lit(not end.startswith((".", "_")))), F.lit(k))
                        for k, end, _ in KINDS])
    return files.withColumn("kind", kind)


def run_inventory(files: DataFrame) -> DataFrame:
    """One row per (Batch, Run) with the bytes of each kind, what is missing or empty, and whether a result exists."""
    known = with_kind(files)
    size = {k: F.max(F.when(F.col("kind") == k, F.col("length"))) for k, _, _ in KINDS}
    out = known.groupBy("Batch", "Run").agg(*[c.alias(k) for k, c in size.items()])
    floor = {k: b for k, _, b in KINDS}
    probs = [F.when(F.col(f"`{k}`").isNull(), F.lit(f"{k} MISSING"))
             .when(F.col(f"`{k}`") < floor[k], F.concat(F.lit(f"{k} EMPTY ("), F.col(f"`{k}`").cast("string"), F.lit(" B)"))) for k in REQUIRED]
    return out.withColumns({"problems": F.array_compact(F.array(*probs)),
                            "has_result": F.coalesce(F.col("C tensor") > RESULT_BYTES, F.lit(False))})
