"""Rows that come out of an explode are spread over tasks and never go through the driver."""

import pytest

import __spark_entry__ as entry
from trabecula.catalog import clouds, shapes, tensors
from trabecula.catalog.registry import Tables
from trabecula.functions.core import spread_join

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["augmented_rows", "cloud_augment", "cloud_check", "cloud_density_channel", "cloud_jitter", "cloud_rebuild_diff", "cloud_sample_coverage", "cloud_sample_on_surface",
                                  "cloud_seed_probe", "cloud_unit_box", "mesh_curvature_summary", "mesh_fabric", "mesh_health", "mesh_interior", "mesh_interior_curvature", "mesh_wall_hits", "mesh_wall_summary"])
def test_no_broadcast_of_exploded_rows(spark, name):
    """Only columns of the tables themselves, which are estimated rightly, may be broadcast."""
    def made(node):
        return "Generate" in node.nodeName() or any(made(node.children().apply(i)) for i in range(node.children().size()))

    todo = [entry.queries()[name](spark, FOLDER)._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        sides = [node.children().apply(i) for i in range(node.children().size())]
        if "BroadcastHashJoin" in node.nodeName():
            assert not made(sides[0 if "BuildLeft" in node.buildSide().toString() else 1]), node.toString()
        todo += sides


def test_meshes_are_dealt_out(spark, monkeypatch):
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    rows = {tuple(r) for r in shapes.meshes(part).collect()}
    monkeypatch.setattr(shapes, "PARTS_PER_TASK", -(-part.count() // 5))
    dealt = shapes.meshes(part)
    assert dealt.rdd.getNumPartitions() == 5
    assert {tuple(r) for r in dealt.collect()} == rows


def test_rotations_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(shapes, "PARTS_PER_TASK", 40)
    box, turned = (entry.queries()[n](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") for n in ("cloud_unit_box", "cloud_augment"))
    assert box and turned == 3 * box  # points and turns, and both again for the sums


def test_seed_probe_shuffles_no_made_rows(spark, monkeypatch):
    """Triangles and points meet where their mesh was dealt to: only rows of the part table are shuffled."""
    monkeypatch.setattr(shapes, "PARTS_PER_TASK", 40)
    probe = entry.queries()["cloud_seed_probe"](spark, FOLDER)
    shuffles = [line for line in probe._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert shuffles and all("REPARTITION_BY_NUM" in line for line in shuffles)
    parts = [r.p_partkey for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()]
    assert sorted(tuple(r) for r in probe.collect()) == sorted((k, s, s == 5) for k in parts for s in (4, 5))


def test_indices_of_points_are_kept_as_bits(spark):
    """Distinct indices are counted without a shuffle of the points; what repeats, is negative or too large, is no index."""
    pts = spark.createDataFrame([("a", i % 100) for i in range(130)] + [("b", -1), ("b", 0), ("b", 63), ("b", 64), ("b", 127), ("b", 128), (None, 5)], "mesh_id string, i int")
    assert sorted(clouds._indices(pts, 128).collect(), key=str) == [("a", 130, 100), ("b", 6, 4), (None, 1, 1)]
    plan = entry.queries()["cloud_sample_coverage"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[mesh_id" in plan and ", i#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(" in line)


def test_tensors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(shapes, "PARTS_PER_TASK", 40)
    rows = tensors._ortho(Tables(spark, FOLDER), "p_size")
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 40) > 1
    assert rows.select("p_partkey", "p_size").exceptAll(spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey", "p_size")).isEmpty()


def test_training_rows_are_dealt_out(spark, monkeypatch):
    from trabecula.learn import forest
    monkeypatch.setattr(forest, "FIT_ROWS", 100)
    rows = spark.range(250, numPartitions=1)
    assert forest.dealt(rows, 250).rdd.getNumPartitions() == 3 and forest.dealt(rows, 250).count() == 250
    assert forest.dealt(rows, 100).rdd.getNumPartitions() == 1


def test_spread_join_meets_nulls(spark):
    left, right = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string"), spark.createDataFrame([(1, 2.0), (None, 3.0)], "k int, y double")
    j = spread_join(left, right, ["k"])
    assert sorted((r.x, r.y) for r in j.collect()) == [("a", 2.0), ("b", 3.0)]
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
