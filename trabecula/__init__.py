"""Spark-first analytics for simulated materials, meshes and inverse design."""
