"""Solver text and JSON files (S2, S3, S6, S7, S8, DM19, DM20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.functions.names import last_number
from trabecula.functions.tensor import symmetrise
from trabecula.sources.tables import run_name

# Texts a tensor file may not hold, and how output names map to quantities.
BAD_CELLS = ("nan", "inf", "-inf", "infinity", "-infinity", "")
MIN_TENSOR_BYTES = 100
QUANTITIES = ("gausscurv", "meancurv", "rho_rel")


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    name = F.element_at(F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per small text file: path, stem, folder, value."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    p = F.col("_metadata.file_path")
    return df.select(p.alias("path"), file_stem(p).alias("stem"), run_name().alias("folder"), F.col("_metadata.file_size").alias("bytes"), "value")


def _cells(text: Column) -> Column:
    """Lines of trimmed cells; ',' and ';' both separate, a byte-order mark is dropped."""
    clean = F.replace(F.regexp_replace(text, "^﻿", ""), F.lit(";"), F.lit(","))
    return F.transform(F.split(clean, r"\r\n|\n|\r"), lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c)))


def parse_tensor(text: str | Column, block: str = "first") -> Column:
    """Lines with at least six numbers, the first (or last) six of them, symmetrised; null when fewer."""
    text = F.col(text) if isinstance(text, str) else text
    nums = F.transform(_cells(text), lambda line: F.array_compact(F.transform(line, lambda c: c.try_cast("double"))))
    rows = F.transform(F.filter(nums, lambda r: F.size(r) >= 6), lambda r: F.slice(r, 1, 6))
    six = F.slice(rows, 1, 6) if block == "first" else F.slice(rows, -6, 6)
    return F.when(F.size(rows) >= 6, F.flatten(six))


def read_tensors(spark: SparkSession, path: str, block: str = "first") -> DataFrame:
    """(path, stem, topology, density, c) of every tensor file below a folder."""
    df = read_whole(spark, path).withColumn("raw", parse_tensor("value", block))
    ok = df.where(F.col("raw").isNotNull())
    return ok.select("path", "stem", F.col("folder").alias("topology"), last_number("stem").alias("density"), symmetrise("raw").alias("c"))


def tensor_file_check(files: DataFrame, text: str = "value", size: str = "bytes") -> DataFrame:
    """(ok, reason) per tensor file: size, equal row lengths without trailing blanks, no NaN or infinity."""
    trimmed = F.transform(F.split(F.col(text), r"\r\n|\n|\r"), lambda l: F.regexp_replace(l, r"[,\s]+$", ""))
    lines = F.transform(F.filter(trimmed, lambda l: l != ""), lambda l: F.transform(F.split(l, ","), lambda c: F.lower(F.trim(c))))
    df = files.withColumn("__l", lines)
    width = F.size(F.get("__l", F.lit(0)))
    reason = (F.when(F.col(size) <= MIN_TENSOR_BYTES, "too small").when(F.size("__l") < 1, "no data")
              .when(F.exists("__l", lambda r: F.size(r) != width), "row lengths differ")
              .when(F.exists("__l", lambda r: F.exists(r, lambda c: c.isin(*BAD_CELLS))), "bad value").otherwise("OK"))
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "OK").drop("__l")


def last_numeric(line: str | Column) -> Column:
    """S3: number in the last non-blank cell of a line; null when that cell is no number."""
    line = F.col(line) if isinstance(line, str) else line
    cells = F.filter(F.transform(F.split(F.replace(line, F.lit(";"), F.lit(",")), ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.try_element_at(cells, F.lit(-1)).try_cast("double")


def read_stress(spark: SparkSession, path: str, load_case: str) -> DataFrame:
    """S3: nodal stresses as rows (run, load_case, value). Plain line scan, so large maps are split over tasks."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    out = df.select(run_name().alias("run"), F.lit(load_case).alias("load_case"), last_numeric("value").alias("value"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def quantity_of(name: Column) -> Column:
    """Which quantity a table column holds. Gaussian is tested first: its names also contain 'curv'."""
    n = F.lower(F.trim(name))
    return (F.when(n.contains("gauss") | n.endswith("_k") | n.contains("_k_"), "gausscurv")
            .when(n.contains("mean") | n.contains("curv") | n.endswith("_h") | n.contains("_h_"), "meancurv")
            .when(n.contains("rel") | n.contains("rho"), "rho_rel"))


def scalar_names(name: Column) -> Column:
    """Names a plain output answers to: its own, folded, and its quantity (only normalised curvature names count)."""
    n = F.replace(F.replace(F.trim(name), F.lit("ρ"), F.lit("rho")), F.lit("σ"), F.lit("sigma"))
    n = F.replace(F.lower(n), F.lit(" "), F.lit("_"))
    known = F.when(n.contains("mn_k") | n.contains("gausscurv"), "gausscurv").when(n.contains("mn_h") | n.contains("meancurv"), "meancurv")
    return F.array_distinct(F.array_compact(F.array(F.nullif(n, F.lit("")), known)))


def read_outputs(files: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """(key, quantity, value) from solver output JSON, tables and scalars, as VARIANT; a later entry wins.

    A file that names nothing but holds a number gives it as rho_rel.
    """
    v = files.select(*key, F.try_parse_json(F.col(text)).alias("v"))
    entries = v.select(*key, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "e"))
    kind = F.coalesce(F.try_variant_get("e", "$.type", "string"), F.lit(""))
    cols = entries.where(kind == "table").select(*key, "at", F.posexplode(F.try_variant_get("e", "$.value.table.columns", "array<variant>")).alias("sub", "c"))
    table = cols.select(*key, "at", "sub", quantity_of(F.coalesce(F.try_variant_get("c", "$.name", "string"), F.lit(""))).alias("quantity"),
                        F.try_variant_get("c", "$.rows[0]", "string").try_cast("double").alias("value"))
    shapes = ["$.value.val", "$.value.value", "$.value.values", "$.value.values[0]", "$.value.val[0]", "$.value[0]", "$.value"]

    def num(p):
        raw = F.try_variant_get("e", p, "variant")
        return F.when(F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get("e", p, "double"))
    scalars = entries.where(kind != "table").select(
        *key, "at", F.lit(0).alias("sub"), F.explode(scalar_names(F.coalesce(F.try_variant_get("e", "$.name", "string"), F.lit("")))).alias("quantity"),
        F.coalesce(*[num(p) for p in shapes]).alias("value"))
    found = table.unionByName(scalars).where(F.col("quantity").isNotNull() & F.col("value").isNotNull())
    found = found.groupBy(*key, "quantity").agg(F.max_by("value", F.struct("at", "sub")).alias("value"))
    nameless = files.join(found.select(*key).distinct(), key, "left_anti")
    first = F.regexp_extract(F.col(text), r'"(?:val|value|values)"\s*:\s*\[?\s*(-?[0-9][0-9.eE+-]*)', 1).try_cast("double")
    rest = nameless.select(*key, F.lit("rho_rel").alias("quantity"), first.alias("value")).where(F.col("value").isNotNull())
    return found.unionByName(rest)


def outputs_wide(found: DataFrame, key: list[str]) -> DataFrame:
    """One row per run with rho_rel, meancurv and gausscurv."""
    return found.groupBy(*key).agg(*[F.max(F.when(F.col("quantity") == q, F.col("value"))).alias(q) for q in QUANTITIES])


def table_width(files: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """Columns of the output table (null: no table in the file)."""
    v = files.select(*key, F.try_parse_json(F.col(text)).alias("v"))
    e = v.select(*key, F.explode_outer(F.try_variant_get("v", "$", "array<variant>")).alias("e"))
    n = F.when(F.try_variant_get("e", "$.type", "string") == "table",
               F.size(F.coalesce(F.try_variant_get("e", "$.value.table.columns", "array<variant>"), F.array())))
    return e.groupBy(*key).agg(F.max(n).cast("long").alias("n_columns"))


def parse_curvature(files: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """rho_rel, meancurv, gausscurv from a small CSV, by header name; by position when no name is known (flagged)."""
    rows = F.filter(F.transform(_cells(F.col(text)), lambda r: F.filter(r, lambda c: c != "")), lambda r: F.size(r) > 0)
    df = files.select(*key, rows.alias("r"))
    def numeric(c):
        return c.try_cast("double").isNotNull()
    heads = F.filter("r", lambda r: ~F.exists(r, numeric))
    data = F.filter("r", lambda r: F.exists(r, numeric))
    df = df.withColumns({"h": F.try_element_at(heads, F.lit(-1)), "d": F.transform(F.get(data, F.lit(0)), lambda c: c.try_cast("double"))})
    named = F.when(F.size("h") == F.size("d"), F.zip_with("h", "d", lambda n, x: F.struct(quantity_of(n).alias("q"), x.alias("x"))))
    df = df.withColumn("m", F.coalesce(F.filter(named, lambda s: s["q"].isNotNull() & s["x"].isNotNull()), F.array().cast("array<struct<q:string,x:double>>")))
    def by_name(q):
        return F.try_element_at(F.filter("m", lambda s: s["q"] == q), F.lit(-1))["x"]
    fallback = (F.size("m") == 0) & F.col("d").isNotNull()
    pos = {"rho_rel": 0, "meancurv": 1, "gausscurv": 2}
    return df.select(*key, *[F.when(fallback, F.get("d", F.lit(i))).otherwise(by_name(q)).alias(q) for q, i in pos.items()],
                     F.coalesce(fallback, F.lit(False)).alias("fallback_used"))


RUN_INFO_SCHEMA = "inputs map<string,double>, ok boolean, exit_code int, time_s double, outputs map<string,double>, timestamp string"


def parse_run_info(files: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """DM20: run metadata; `has_metadata` needs at least one input."""
    j = F.from_json(F.col(text), RUN_INFO_SCHEMA)
    return files.select(*key, j.alias("j")).select(*key, "j.*").withColumn("has_metadata", F.coalesce(F.size("inputs") > 0, F.lit(False)))
