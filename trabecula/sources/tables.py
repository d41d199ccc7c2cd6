"""Tabular scans with explicit schemas (S1, S10-S13, DM15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a feature row and of a master row.
FEATURE_SCHEMA = """dataset string, file string, topology string, inner double, density_param double, t_input double,
 seed int, size_multi double, bbox_mm double, n_tris long, watertight int, winding_ok int, euler int, VF double,
 SAV_x_cell double, rel_surface double, interior_vert_frac double, curv_gauss_mean_xL2 double, curv_gauss_iqr_xL2 double,
 curv_mean_mean_xL double, curv_mean_iqr_xL double, curv_gauss_p99_xL2 double, curv_mean_p99_xL double,
 thickness_med_mm double, thickness_std_mm double, thickness_hits int, thickness_over_cell double, thickness_ratio double,
 fabric_l1 double, fabric_l2 double, fabric_l3 double, fabric_DA double, fabric_aniso double, normal_x double,
 normal_y double, normal_z double, normal_spread double, fabric_kept_frac double, extract_s double, status string"""
MASTER_SCHEMA = """Run string, Version string, Batch string, Density double, Thickness double, Inner_Size double,
 Size_Multi double, Seed int, Cell_Size_mm double, Rho_rel double, MeanCurv_STL double, GaussCurv_STL double,
 E_iso_GPa double, E_over_Es double, nu_iso double, G_iso_GPa double, G_over_Gs double, TAI double, Zener_Z double,
 A_U double, E_min_GPa double, E_max_GPa double, dE_GPa double, C11_GPa double, C12_GPa double, C44_GPa double,
 Sigma_applied_MPa double, Sigma_p99_MPa double, Sigma_max_raw_MPa double, Yield_onset_MPa double, SCF_p99 double,
 Tau_applied_MPa double, Shear_p99_MPa double, Shear_max_raw_MPa double, Shear_onset_MPa double, SCF_shear_p99 double,
 Sigma_ys_MPa double, Status string, Time_min double"""
LOOKUP_SCHEMA = "density double, t double, vf_actual double"
OOF_SCHEMA = "Run string, target string, model string, VF double, y_true double, y_pred double"
NET_SCHEMA = "Run string, target string, y_true double, y_pred double"
FOLD_SCHEMA = "Run string, fold int"


def read_csv(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header; blanks are null, NaN becomes null."""
    df = spark.read.schema(schema).option("mode", mode).csv(path, header=True, nullValue="", nanValue="NaN", enforceSchema=False)
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Density to t lookup."""
    return read_csv(spark, path, LOOKUP_SCHEMA, "PERMISSIVE").select("density", "t")


def run_name(path: str | Column = None) -> Column:
    """Name of the folder a row's file lies in."""
    p = F.col("_metadata.file_path") if path is None else (F.col(path) if isinstance(path, str) else path)
    return F.element_at(F.split(F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), "/"), -2)


def read_predictions(spark: SparkSession, root: str, predictions: str, folds: str | None = None, schema: str = NET_SCHEMA) -> DataFrame:
    """Prediction files of all run folders below `root`, with the folds of the same run."""
    p = spark.read.schema(schema).csv(f"{root}/*/{predictions}", header=True, nullValue="").withColumn("run_folder", run_name())
    if folds is None:
        return p
    f = spark.read.schema(FOLD_SCHEMA).csv(f"{root}/*/{folds}", header=True).withColumn("run_folder", run_name())
    f = f.select(F.col("run_folder").alias("__r"), F.col("Run").alias("__s"), "fold")
    return p.join(f, (F.col("run_folder") == F.col("__r")) & (F.col("Run") == F.col("__s")), "left").drop("__r", "__s")


def newest(files: DataFrame, name: str = "path") -> DataFrame:
    """The last name in text order."""
    return files.agg(F.max(name).alias(name))


def newest_per(files: DataFrame, keys: list[str], name: str = "path") -> DataFrame:
    """S13 per pattern or family."""
    return files.groupBy(*keys).agg(F.max(name).alias(name))
