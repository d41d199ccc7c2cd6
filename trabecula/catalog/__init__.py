"""Catalogue of runnable queries, one module per area."""

from __future__ import annotations

import importlib

AREAS = ("linkage", "versions", "quality", "scoring", "fitting", "search", "parsing", "tensors", "meshes", "clouds",
         "folds", "learning", "files", "streams", "datasets")


def load() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        importlib.import_module(f"trabecula.catalog.{area}")
