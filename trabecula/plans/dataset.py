"""Dataset build: link, normalise, de-duplicate, merge and gate (entry 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.functions import gates, names, tensor, units
from trabecula.operators import dedupe, link, setops

PARAMS = ["variant", "inner", "density", "t", "seed", "size_multi"]
GEOMETRY = ["variant", "inner", "density", "t", "size_multi"]


def label_table(master: DataFrame, labels=units.DEFAULT_LABELS, es_gpa: float = 200.0, sigma_ys_mpa: float = 250.0,
                run: str = "Run", carry: list[str] = ("Status", "Version")) -> DataFrame:
    """Newest version of each run with normalised targets. `master` carries a `seq` column for ties."""
    best = dedupe.latest_version(master, run)
    keep = [run, "seq", *[c for c in carry if c in best.columns]]
    return units.normalise_labels(best, labels, es_gpa, sigma_ys_mpa, keep)


def _linked(features: DataFrame, master: DataFrame, prefix: str, labels, es_gpa: float, sigma_ys_mpa: float, join_on: str) -> DataFrame:
    """Usable features with the label row of their run, or match_kind 'none'."""
    lab = label_table(master, labels, es_gpa, sigma_ys_mpa)
    lab = lab.select("*", names.parse_stem("Run", prefix).alias("__p")).select("*", *[F.col(f"__p.{p}").alias(f"p_{p}") for p in PARAMS]).drop("__p")
    feats = features.where(gates.usable("status")).withColumn("stem", names.strip_suffix("file"))
    feats = feats.select("*", names.parse_stem("stem", prefix).alias("__p")).select("*", *[F.col(f"__p.{p}").alias(f"p_{p}") for p in PARAMS]).drop("__p")
    taken = {c.lower() for c in lab.columns if not c.startswith("p_")}
    feats = feats.drop(*[c for c in feats.columns if c.lower() in taken])
    if join_on == "params":
        return link.link_by_params(feats, lab, "stem", "Run", [f"p_{p}" for p in PARAMS], "seq")
    runs = lab.drop(*[f"p_{p}" for p in PARAMS]).withColumnRenamed("Run", "matched_run")
    out = feats.join(runs, F.col("stem") == names.strip_suffix("matched_run"), "left")
    return out.withColumn("match_kind", F.when(F.col("matched_run").isNotNull(), "exact").otherwise("none"))


def aperiodic_dataset(features: DataFrame, master: DataFrame, prefix: str, labels=units.DEFAULT_LABELS, seed_preference: list[int] = (2, 3, 5, 1),
                      es_gpa: float = 200.0, sigma_ys_mpa: float = 250.0, join_on: str = "params") -> DataFrame:
    """Usable features with labels, one row per geometry. What is left out: `aperiodic_losses`.

    `join_on`: 'params' matches names, then parameters; 'file' matches names only.
    """
    joined = _linked(features, master, prefix, labels, es_gpa, sigma_ys_mpa, join_on)
    targets = [l.target for l in labels if l.role == "target"]
    hit = joined.where(F.col("match_kind") != "none").where(gates.has_any(*targets))
    # The surviving row is described by the parameters of the matched run, as its labels are.
    hit = hit.withColumn("__m", names.parse_stem("matched_run", prefix)).withColumns({f"p_{p}": F.col(f"__m.{p}") for p in PARAMS}).drop("__m")
    kept = dedupe.seed_twins(hit, [f"p_{p}" for p in GEOMETRY], "p_seed", list(seed_preference), "matched_run")
    return kept.withColumnsRenamed({"matched_run": "Run", "p_variant": "variant"}).drop(*[f"p_{p}" for p in PARAMS if p != "variant"])


def aperiodic_losses(features: DataFrame, master: DataFrame, prefix: str, labels=units.DEFAULT_LABELS, es_gpa: float = 200.0, sigma_ys_mpa: float = 250.0,
                     join_on: str = "params") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable features without a run, matched features without any target, the match guard's one row)."""
    joined = _linked(features, master, prefix, labels, es_gpa, sigma_ys_mpa, join_on)
    matched = F.col("match_kind") != "none"
    has = gates.has_any(*[l.target for l in labels if l.role == "target"])
    return joined.where(~matched), joined.where(matched & ~has), link.match_guard(joined, matched)


def periodic_dataset(features: DataFrame, tensors: DataFrame, unit: str, es: float, es_unit: str, nu: float,
                     excluded: list[str] = (), band: tuple[float, float] = (0.85, 1.15), density_bin: float = 0.02,
                     family: str = "periodic", element_order: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dataset, rows rejected by the name gate, rows without a tensor)."""
    index = tensors.where(gates.not_excluded("topology", list(excluded))).withColumn("dkey", link.density_key("density"))
    index = link.with_aliases(index, "topology", ["dkey"], ["path"]).drop("dkey", "alias_rank")
    feats = features.where(gates.usable("status", exact=True))
    feats = feats.withColumns({"Run": names.strip_suffix("file"), "topology": F.trim("topology")})
    feats = feats.withColumn("density", names.last_number("Run"))
    missed = link.link_tensors(feats, index.select("topology", "density"), "left_anti")
    hit = link.link_tensors(feats, index.select("topology", "density", "c"), "inner")
    kept, rejected = gates.split_by(hit, gates.name_ratio_gate("VF", "density", *band))
    es_gpa = es * units.unit_factor(es_unit)
    out = tensor.add_labels(kept, "c", units.unit_factor(unit), es_gpa, nu)
    out = out.withColumns({"Rho_rel": F.col("VF").cast("double"), "element_order": F.lit(element_order), "density_source": F.lit("measured VF")})
    out = out.withColumn("group_key", names.group_key(F.lit(family), "topology", names.density_band("Rho_rel", "VF", density_bin)))
    return out.drop("c", "c_gpa", "s_gpa"), rejected.drop("c"), missed


def combined_dataset(a: DataFrame, b: DataFrame, family_a: str, family_b: str, cell_a: float, cell_b: float,
                     order_a: str = "", order_b: str = "", density_bin: float = 0.02) -> DataFrame:
    """Shared columns of both families, one topology label, group key, measured-length columns."""
    def tagged(d, family, cell, order):
        variant = F.col("variant") if "variant" in d.columns else F.lit(None).cast("string")
        topo = F.col("topology") if "topology" in d.columns else F.lit(None).cast("string")
        d = d.withColumns({"topology": names.topology_of(variant, topo), "family": F.lit(family), "element_order": F.lit(order),
                           "cell_mm": F.lit(float(cell))})
        return d.withColumn("group_key", names.group_key("family", "topology", names.density_band("Rho_rel", "VF", density_bin)))
    both = setops.union_shared(tagged(a, family_a, cell_a, order_a), tagged(b, family_b, cell_b, order_b))
    return units.add_measured_length(both, "cell_mm").drop("cell_mm")
