"""Connected components by alternating large and small stars; every round is cut into a written table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trabecula.llm.common import cut


def fold_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest position joined to it so far) after joining the positions a with b."""
    label = label.copy()
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
    return label


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected `edges` (a, b: longs); the root is the smallest node reachable.

    Minima are combined before the shuffle and written before they are joined, so a node with very many neighbours is split by
    adaptive execution. Rounds run until the edges no longer change: their number grows with the logarithm of the nodes.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(small, "a")
        edges = cut(joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
