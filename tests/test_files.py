import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import CUBE
from trabecula.operators import link, mesh
from trabecula.sources import inventory, master, sinks, stl, tables, text_files
from trabecula.streaming import ingest


def binary_stl(tris):
    body = b"".join(struct.pack("<12fH", 0, 0, 0, *[float(c) for p in t for c in p], 0) for t in tris)
    return b"\0" * 80 + struct.pack("<I", len(tris)) + body


def ascii_stl(tris):
    facets = "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in t) + "endloop\nendfacet\n" for t in tris)
    return f"solid cube\n{facets}endsolid cube\n".encode()


def test_stl_scan_splits_files_and_survives_broken_ones(spark, tmp_path):
    (tmp_path / "Gyroid D").mkdir()
    (tmp_path / "Gyroid D" / "a 1.stl").write_bytes(binary_stl(CUBE))
    (tmp_path / "Gyroid D" / "b.STL").write_bytes(ascii_stl(CUBE))
    (tmp_path / "broken.stl").write_bytes(b"\1" * 3000)
    files = stl.list_stl(spark, str(tmp_path))
    assert {r["file"]: r["topology"] for r in files.collect()}["b.STL"] == "Gyroid D"
    rows = stl.read_triangles(files, chunk=5).cache()
    n = {r["path"].rsplit("/", 1)[1]: r["n"] for r in rows.where("error IS NULL").groupBy("path").agg(F.count_distinct("tri_id").alias("n")).collect()}
    assert n["b.STL"] == 12 and [v for k, v in n.items() if k.startswith("a")] == [12]
    assert rows.where("error IS NOT NULL").count() == 1
    vol = mesh.measures(rows.where("error IS NULL").withColumnRenamed("path", "mesh_id"))
    assert [r["volume"] for r in vol.collect()] == [pytest.approx(1), pytest.approx(1)]
    skipped = stl.list_stl(spark, str(tmp_path), max_mb=0.001).where("status <> 'OK'")
    assert skipped.count() == 2


def test_a_large_ascii_file_is_many_tasks(spark, tmp_path):
    n = 286_000  # two million lines
    lines = ["solid big"]
    for i in range(n):
        lines += ["facet normal 0 0 1", " outer loop", f"  vertex {i} 0 0.5", f"  vertex {i + 1} 0 0.5", f"\tvertex  {i} 1 5e-1", " endloop", "endfacet"]
    (tmp_path / "big.stl").write_text("\n".join([*lines, "endsolid vertex", ""]))
    (tmp_path / "odd.stl").write_text("solid odd\nvertex 1 2 3\nvertex 4 5 6\n" + " " * 3000)
    (tmp_path / "bad.stl").write_text("solid bad\nvertex 1 2 x\n" + " " * 3000)
    rows = stl.read_triangles(stl.list_stl(spark, str(tmp_path)), chunk=40_000).cache()
    big = rows.where(F.col("path").endswith("big.stl")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tri_id").alias("ids"), F.sum((F.col("v0.x") == F.col("tri_id")).cast("int")).alias("placed"),
                                                            F.sum((F.col("v1.x") == F.col("tri_id") + 1).cast("int")).alias("second"), F.sum((F.col("v2.y") == 1).cast("int")).alias("third")).first()
    assert tuple(big) == (n, n, n, n, n)
    assert {r["path"].rsplit("/", 1)[1]: r["error"] is not None for r in rows.where("tri_id = -1").collect()} == {"odd.stl": True, "bad.stl": True}
    assert (tmp_path / "big.stl").stat().st_size > 5 * stl.RECORD * 40_000


def test_stl_sanity(spark, tmp_path):
    (tmp_path / "ok.stl").write_bytes(binary_stl(CUBE * 10))
    (tmp_path / "empty.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 0) + b"\0" * 3000)
    (tmp_path / "tiny.stl").write_bytes(b"x")
    (tmp_path / "text.stl").write_bytes(ascii_stl(CUBE * 4))
    got = {r["path"].rsplit("/", 1)[1]: (r["reason"], r["n_tris"]) for r in stl.check_stl(spark, str(tmp_path)).collect()}
    assert got["ok.stl"] == ("OK (binary)", 120) and got["empty.stl"][0] == "no triangles"
    assert got["tiny.stl"][0] == "too small" and got["text.stl"] == ("OK (ascii)", None)


def test_tensor_and_stress_files(spark, tmp_path):
    rows = [[10 + i + j if i != j else 50 for j in range(6)] for i in range(6)]
    rows[0][1] = 12
    (tmp_path / "P Generator").mkdir()
    (tmp_path / "P Generator" / "P_density0.15.csv").write_text("\n".join(",".join(map(str, r)) + "," for r in rows))
    (tmp_path / "P Generator" / "short_0.20.csv").write_text("1,2,3\n4,5,6\n")
    t = text_files.read_tensors(spark, str(tmp_path)).collect()
    assert len(t) == 1 and t[0]["topology"] == "P Generator" and t[0]["density"] == 0.15
    assert t[0]["c"][1] == t[0]["c"][6] == pytest.approx(11.5)
    (tmp_path / "s" / "run_1").mkdir(parents=True)
    (tmp_path / "s" / "run_1" / "x_stress.csv").write_text("x,y,z,vm\n0,0,0,1e6\n1;1;1;3e6\n2,2,2,\n5,,\n")
    s = text_files.read_stress(spark, str(tmp_path / "s"), "compression").collect()
    assert sorted(r["value"] for r in s) == [2.0, 5.0, 1e6, 3e6] and {r["run"] for r in s} == {"run_1"}


def test_inventory_and_reconcile(spark, tmp_path):
    for run, files in {"r1": {"r1.csv": 300, "r1_stress.csv": 50, "r1_shear_stress.csv": 50, "r1.stl": 5000, "outputs.json": 60},
                       "r2": {"r2.csv": 10, "run_info.json": 40}, "r3": {"r3.csv": 300}}.items():
        d = tmp_path / "20260713_17-24_RUN" / "Data" / run
        d.mkdir(parents=True)
        for f, n in files.items():
            (d / f).write_text("x" * n)
    inv = inventory.run_inventory(inventory.list_files(spark, str(tmp_path))).cache()
    got = {r["Run"]: r for r in inv.collect()}
    assert got["r1"]["problems"] == [] and got["r1"]["has_result"]
    assert "C tensor EMPTY (10 B)" in got["r2"]["problems"] and not got["r2"]["has_result"]
    assert got["r1"]["Batch"] == "20260713_17-24_RUN"
    master = spark.createDataFrame([("r1", "20260713_17-24_RUN")], "Run string, Batch string")
    gaps = link.reconcile(inv.withColumn("has_metadata", F.lit(False)), master)
    assert {r["Run"]: r["gap"] for r in gaps.collect()} == {"r2": "no result", "r3": "no metadata"}


def test_csv_scan_and_predictions(spark, tmp_path):
    (tmp_path / "look.csv").write_text("density,t,vf_actual\n0.2,0.5,\n0.1,NaN,0.1\n")
    rows = {r["density"]: r["t"] for r in tables.read_lookup(spark, str(tmp_path / "look.csv")).collect()}
    assert rows == {0.2: 0.5, 0.1: None}
    for run in ("a_seed1", "a_seed2"):
        d = tmp_path / "runs" / run
        d.mkdir(parents=True)
        (d / "p.csv").write_text("Run,target,y_true,y_pred\nx,E,1,2\ny,E,3,3\n")
        (d / "f.csv").write_text("Run,fold\nx,0\n")
    p = tables.read_predictions(spark, str(tmp_path / "runs"), "p.csv", "f.csv").collect()
    assert sorted((r["run_folder"], r["Run"], r["fold"]) for r in p if r["fold"] is not None) == [("a_seed1", "x", 0), ("a_seed2", "x", 0)]
    assert len(p) == 4


def test_dataset_and_run_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.3), ("b", None), ("c", 0.1)], "Run string, VF double")
    sinks.write_dataset(df, str(tmp_path / "ds"))
    assert spark.read.parquet(str(tmp_path / "ds")).count() == 3
    sinks.write_dataset(df, str(tmp_path / "csv"), fmt="csv")
    path = sinks.write_run(df, str(tmp_path / "runs"), "20260101_10-00", "scores")
    back = spark.read.parquet(str(tmp_path / "runs" / "scores"))
    assert path.endswith("run_stamp=20260101_10-00") and back.count() == 3 and "run_stamp" in back.columns


def test_manifest_is_order_free(spark):
    df = spark.createDataFrame([("a", 0.3, 1.0), ("b", 0.2, None)], "Run string, VF double, TAI double")
    a = sinks.manifest(df, ["TAI"], "VF", seeds="1,2").first()
    b = sinks.manifest(df.orderBy("VF"), ["TAI"], "VF", seeds="1,2").first()
    c = sinks.manifest(df.withColumn("VF", F.col("VF") + 1), ["TAI"], "VF").first()
    assert a["fingerprint"] == b["fingerprint"] != c["fingerprint"]
    assert a["label_n"] == {"TAI": 1} and a["vf_min"] == 0.2 and a["seeds"] == "1,2"
    assert json.loads(df.sparkSession.createDataFrame([a]).toJSON().first())["n_rows"] == 2


def test_master_append_keeps_columns_and_rows(spark, tmp_path):
    path = str(tmp_path / "master")
    one = spark.createDataFrame([("r1", "b1", "OK", 1.0)], "Run string, Batch string, Status string, E double")
    two = spark.createDataFrame([("r1", "b1", "FAIL", "x"), ("r2", "b2", "OK", "y")], "Run string, Batch string, Status string, note string")
    sinks.append_master(one, path)
    out = {r["Run"]: r for r in sinks.append_master(two, path).collect()}
    assert out["r1"]["Status"] == "OK" and out["r1"]["E"] == 1.0 and out["r1"]["note"] is None and out["r2"]["note"] == "y"


def test_a_commit_has_few_files(spark, tmp_path):
    """Tasks don't each write files of every batch and every key bucket."""
    path = str(tmp_path / "few")
    n = F.col("id")
    rows = spark.range(0, 4000, 1, 40).select(n.cast("string").alias("Run"), (n % 3).cast("string").alias("Batch"), F.lit("OK").alias("Status"))
    master.commit_rows(rows, path, "one")
    data, keys = (list((tmp_path / "few" / kind).rglob("*.parquet")) for kind in ("data", "keys"))
    assert len(data) <= 3 * master.SPREAD and len(keys) == len({f.parent for f in keys})
    assert sinks.read_master(spark, path).select(rows.columns).exceptAll(rows).isEmpty() and sinks.read_master(spark, path).count() == 4000


def test_stream_into_versioned_master(spark, tmp_path):
    drop, master, state = str(tmp_path / "drop"), str(tmp_path / "master"), str(tmp_path / "state")
    schema = "Run string, Batch string, Status string"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drop)
        ingest.ingest_runs(ingest.read_run_stream(spark, drop, schema, files_per_batch=1), master, state).awaitTermination()

    deliver([("s1", "20260101_10-00_RUN", "OK"), ("s2", "20260101_10-00_RUN", "FAIL (x)")])
    deliver([("s1", "20260102_10-00_RUN", "OK"), ("s2", "20260102_10-00_RUN", "OK"), ("s1", "20260103_10-00_RUN", "OK")])
    deliver([("s1", "20260102_10-00_RUN", "OK")])
    got = sorted((r["Run"], r["Batch"][:8], r["Version"]) for r in sinks.read_master(spark, master).collect())
    assert got == [("s1", "20260101", "v1"), ("s1", "20260102", "v2"), ("s1", "20260103", "v3"), ("s2", "20260101", "v1"), ("s2", "20260102", "v1")]


def test_stream_goes_on_from_an_older_master_without_reading_it(spark, tmp_path):
    drop, path, state = str(tmp_path / "drop"), str(tmp_path / "master"), str(tmp_path / "state")
    schema = "Run string, Batch string, Status string"
    old = spark.createDataFrame([("s1", "20250101", "OK", "v1"), ("s1", "20250102", "FAIL", "v2"), ("s2", "20250101", "OK", "v1")], schema + ", Version string")
    before = sinks.append_master(old, path)
    for rows in ([("s1", "20250102", "OK"), ("s1", "20260101", "OK")], [("s1", "20260102", None), ("s3", "20260101", "ERROR"), ("s3", "20260101", "OK"), (None, "x", "OK")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drop)
        q = ingest.ingest_runs(ingest.read_run_stream(spark, drop, schema), path, state, initial=before)
        q.awaitTermination()
    got = sorted((r["Run"] or "", r["Batch"], r["Version"]) for r in sinks.read_master(spark, path).where("Batch >= '2026'").collect())
    assert got == [("", "x", "v1"), ("s1", "20260101", "v2"), ("s1", "20260102", "v3"), ("s3", "20260101", "v1")]
    rows = ingest.versioned(ingest.read_run_stream(spark, drop, schema))
    assert path not in rows._jdf.queryExecution().analyzed().toString()


def test_a_killed_append_leaves_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "master")
    one = spark.createDataFrame([("r1", "b1", "OK"), ("r2", "b1", "OK")], "Run string, Batch string, Status string")
    two = spark.createDataFrame([("r2", "b1", "OK", 1), ("r3", "b2", "OK", 2), (None, None, "OK", 3)], "Run string, Batch string, Status string, x int")
    sinks.append_master(one, path, commit="first")
    from trabecula.sources import master

    def dies(spark, p):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(master, "_any_file", dies)  # the data is written, keys and record are not
        with pytest.raises(RuntimeError):
            sinks.append_master(two, path, commit="second")
    assert sinks.read_master(spark, path).count() == 2 and "x" not in sinks.read_master(spark, path).columns
    for _ in range(2):  # repeated, and once more without effect
        out = sinks.append_master(two, path, commit="second")
        assert sorted((r["Run"] or "", r["Batch"] or "", r["x"] or 0) for r in out.collect()) == [("", "", 3), ("r1", "b1", 0), ("r2", "b1", 0), ("r3", "b2", 2)]
    assert [r["n_rows"] for r in master.commits(spark, path)] == [2, 2]
    with pytest.raises(ValueError):
        sinks.append_master(spark.createDataFrame([("r9", "b9", "OK", "text")], "Run string, Batch string, Status string, x string"), path)


def test_usable_row_of_a_repeated_key_wins(spark, tmp_path):
    rows = spark.createDataFrame([("r", "b", "OK", 1.0), ("r", "b", "ERROR bad", None), ("r", "c", "FAIL", None)], "Run string, Batch string, Status string, x double")
    kept = {(r.Run, r.Batch): r.Status for r in sinks.append_master(rows, str(tmp_path / "master")).collect()}
    assert kept == {("r", "b"): "OK", ("r", "c"): "FAIL"}


def test_ascii_ranges_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """Names of ranges are few bytes, yet their ranges are read by many tasks; small ranges leave a task together."""
    facet = "facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {i} {i + 1} {i + 2}\n" for i in range(3)) + "endloop\nendfacet\n"
    (tmp_path / "a.stl").write_text("solid a\n" + facet * 400 + "endsolid\n")
    monkeypatch.setattr(stl, "TASK_BYTES", 5000)
    files = stl.list_stl(spark, str(tmp_path))
    length = files.first()["length"]
    assert stl._tasks(files, F.ceil(F.col("length") / 500), 500) == -(-(-(-length // 500)) // 10)
    tri = stl.read_triangles(files, chunk=10)
    assert tri.where("error IS NULL").select("tri_id").distinct().count() == 400 and tri.count() == 400
    frames = list(stl._decode_corners(iter([pd.DataFrame({"path": str(tmp_path / "a.stl"), "part": range(8), "start": [500 * k for k in range(8)], "end": [500 * k + 500 for k in range(8)]})])))
    assert len(frames) == 1 and len(frames[0]) > 50
