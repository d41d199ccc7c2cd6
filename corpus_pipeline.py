"""Corpus pipeline: toxicity, exact duplicates, near-duplicates, benchmark passages, packing.

Each stage is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trabecula.llm.block_naming import exact_dedup_stage
from trabecula.llm.decontamination import decontamination_stage
from trabecula.llm.packing import packing_stage
from trabecula.llm.simhash import near_dedup_stage
from trabecula.llm.toxicity import toxicity_stage
from trabecula.session import ensure_checkpoint_dir

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Learned scores, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
