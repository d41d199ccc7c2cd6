"""File-format queries: the texts are built from the tables, the parsers are those the file scans use (S2-S9, DM20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.catalog.shapes import FACE, TRI, meshes
from trabecula.functions import vec
from trabecula.functions.tensor import at, symmetrise
from trabecula.session import ensure_checkpoint_dir
from trabecula.sources import inventory, sinks, stl, tables, text_files

_V = "embedding::DOUBLE[]"


def _tensor_text(t):
    """A header line, seven lines of six numbers, some with trailing separators or a blank line."""
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 42)
    sep = F.when(F.col("vec_id") % 2 == 0, ",").otherwise("; ")
    lines = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.array_join(F.transform(F.slice(F.col("v"), i * 6 + 1, 6), lambda x: x.cast("string")), ","))
    e = t.embeddings.select("vec_id", v.alias("v"), sep.alias("sep"))
    body = F.array_join(F.transform(lines, lambda l: F.concat(F.replace(l, F.lit(","), F.col("sep")), F.when(F.col("vec_id") % 3 == 0, ",").otherwise(""))), "\n")
    keep = F.when(F.col("vec_id") % 10 == 9, F.substring_index(body, "\n", 5)).otherwise(body)
    return e.select("vec_id", "v", F.concat(F.lit("﻿C tensor, MPa\n"), keep, F.lit("\r\n\n")).alias("value"))


@query("tensor_files_first", f"WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings WHERE vec_id % 10 <> 9) SELECT vec_id, round(v[1], 9) AS c11, round(0.5 * (v[2] + v[7]), 9) AS c12, round(v[36], 9) AS c66 FROM e")
def tensor_files_first(t):
    p = _tensor_text(t).withColumn("raw", text_files.parse_tensor("value")).where("raw IS NOT NULL").withColumn("c", symmetrise("raw"))
    return p.select("vec_id", F.round(at("c", 0, 0), 9).alias("c11"), F.round(at("c", 0, 1), 9).alias("c12"), F.round(at("c", 5, 5), 9).alias("c66"))


@query("tensor_files_last", f"WITH e AS (SELECT vec_id, ({_V})[7:] AS v FROM embeddings WHERE vec_id % 10 <> 9) SELECT vec_id, round(v[1], 9) AS c11, round(v[36], 9) AS c66 FROM e")
def tensor_files_last(t):
    p = _tensor_text(t).withColumn("c", text_files.parse_tensor("value", "last")).where("c IS NOT NULL")
    return p.select("vec_id", F.round(at("c", 0, 0), 9).alias("c11"), F.round(at("c", 5, 5), 9).alias("c66"))


@query("tensor_file_check", """SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'too small' WHEN 1 THEN 'row lengths differ' WHEN 2 THEN 'bad value' ELSE 'OK' END AS reason, vec_id % 5 > 2 AS ok FROM embeddings""")
def tensor_file_check(t):
    k = F.col("vec_id") % 5
    good = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.array_join(F.transform(F.slice(F.col("embedding"), i * 6 + 1, 6), lambda x: x.cast("string")), ","), F.lit(","))), "\n")
    text = F.when(k == 1, F.concat(good, F.lit("\n1,2,3"))).when(k == 2, F.concat(good, F.lit("\n1,2,NaN,4,5,6"))).otherwise(F.concat(good, F.lit("\n\n")))
    f = t.embeddings.select("vec_id", text.alias("value"), F.when(k == 0, 90).otherwise(400).alias("bytes"))
    return text_files.tensor_file_check(f).select("vec_id", "reason", "ok")


@query("stress_lines", "SELECT event_type AS run, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 4 <> 3 GROUP BY 1")
def stress_lines(t):
    k, v = F.col("event_id") % 4, F.col("value").cast("string")
    line = F.when(k == 0, F.concat(F.lit("1.5, 2.5,"), v)).when(k == 1, F.concat(F.lit("0;1;"), v, F.lit("; ;"))).when(k == 2, v).otherwise(F.concat(v, F.lit(",Pa")))
    e = t.events.select(F.col("event_type").alias("run"), text_files.last_numeric(line).alias("v"))
    return e.where("v IS NOT NULL").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


def _json(t):
    k, v, u = F.col("event_id") % 4, F.col("value").cast("string"), F.col("user_id").cast("string")
    tab = F.format_string('[{"name":"Table","type":"table","value":{"table":{"columns":[{"name":"p_rel","rows":["%s"]},{"name":"avg_Mn_K","rows":["%s"]},{"name":"avg_Mn_H","rows":["x"]}]}}}]', v, u)
    plain = F.format_string('[{"name":"ρ rel","type":"real","value":{"isFinite":true,"units":{},"val":%s}},{"name":"Average_Mn_H","value":%s}]', v, u)
    bare = F.format_string('{"value":{"val":%s}}', v)
    return t.events.select("event_id", F.when(k == 0, tab).when(k == 1, plain).when(k == 2, bare).otherwise("not json").alias("value"))


@query("solver_outputs", """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1, 2) THEN value END AS rho_rel, CASE WHEN event_id % 4 = 1 THEN user_id * 1.0::DOUBLE END AS meancurv, CASE WHEN event_id % 4 = 0 THEN user_id * 1.0::DOUBLE END AS gausscurv FROM events WHERE event_id % 4 <> 3""")
def solver_outputs(t):
    return text_files.outputs_wide(text_files.read_outputs(_json(t), ["event_id"]), ["event_id"])


@query("output_table_width", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 3::BIGINT END AS n_columns FROM events")
def output_table_width(t):
    return text_files.table_width(_json(t), ["event_id"])


@query("curvature_files", """SELECT event_id, value AS rho_rel, CASE event_id % 3 WHEN 0 THEN user_id * 1.0::DOUBLE WHEN 1 THEN user_id + 0.5::DOUBLE ELSE user_id * 1.0::DOUBLE END AS meancurv,
 CASE event_id % 3 WHEN 0 THEN user_id + 0.5::DOUBLE WHEN 1 THEN user_id * 1.0::DOUBLE ELSE user_id + 0.5::DOUBLE END AS gausscurv, event_id % 3 = 2 AS fallback_used FROM events""")
def curvature_files(t):
    k, v, u = F.col("event_id") % 3, F.col("value").cast("string"), F.col("user_id").cast("string")
    body = F.concat_ws(";", v, u, F.concat(u, F.lit(".5")))
    text = F.when(k == 0, F.concat(F.lit("p_rel;MeanCurv;GaussCurv\n"), body)).when(k == 1, F.concat(F.lit("\np_rel, avg_Mn_K, avg_Mn_H,\r\n"), F.replace(body, F.lit(";"), F.lit(",")), F.lit(",\n"))).otherwise(body)
    return text_files.parse_curvature(t.events.select("event_id", text.alias("value")), ["event_id"])


@query("run_metadata", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS density, event_id % 3 = 0 AS has_metadata FROM events""")
def run_metadata(t):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.format_string('{"inputs":{"Density":%s,"Seed":2},"ok":true,"exit_code":0,"time_s":12.5}', F.col("value").cast("string"))).when(k == 1, '{"inputs":{},"ok":false}').otherwise("broken")
    out = text_files.parse_run_info(t.events.select("event_id", text.alias("value")), ["event_id"])
    return out.select("event_id", F.try_element_at("inputs", F.lit("Density")).alias("density"), "has_metadata")


@query("event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def event_properties(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"))


@query("run_inventory", """WITH r AS (SELECT o_orderkey, o_custkey, 30 + o_orderkey % 100 AS b FROM orders)
SELECT o_orderkey AS order_key, concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'shear MISSING' END, CASE WHEN o_orderkey % 5 = 0 THEN 'STL EMPTY (500 B)' END) AS problems, b + 50 > 100 AS has_result FROM r""")
def run_inventory(t):
    k = F.col("o_orderkey")
    run = F.concat(F.lit("run_"), k.cast("string"))
    def f(name, size):
        return F.struct(name.alias("file"), size.cast("long").alias("length"))
    files = F.array_compact(F.array(
        f(F.concat(run, F.lit(".csv")), 80 + k % 100), f(F.concat(run, F.lit("_stress.csv")), F.lit(40)), F.when(k % 3 != 0, f(F.concat(run, F.lit("_shear_stress.csv")), F.lit(40))),
        f(F.concat(run, F.lit(".stl")), F.when(k % 5 == 0, 500).otherwise(5000)), f(F.lit("outputs.json"), F.lit(60)), f(F.lit("log.txt"), F.lit(9))))
    listed = t.orders.select(run.alias("Run"), F.lit("b1").alias("Batch"), F.inline(files))
    inv = inventory.run_inventory(listed)
    return inv.select(F.substring("Run", 5, 20).cast("long").alias("order_key"), F.array_join("problems", "; ").alias("problems"), "has_result")


@query("resume_remaining", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 10 = 0")
def resume_remaining(t):
    todo = t.part.select("p_partkey", F.col("p_brand").alias("topology"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"))
    done = todo.where("p_partkey % 2 = 0").select("topology", "file", F.when(F.col("p_partkey") % 10 == 0, "ERROR bad mesh").otherwise("OK").alias("status"))
    return sinks.remaining(todo, done).select("p_partkey")


@query("newest_files", "SELECT o_custkey, max(strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey) AS path FROM orders GROUP BY 1")
def newest_files(t):
    f = t.orders.select("o_custkey", F.concat_ws("_", F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey").cast("string")).alias("path"))
    return tables.newest_per(f, ["o_custkey"])


@query("dataset_manifest", """SELECT count(*) AS n_rows, min(l_discount) AS vf_min, max(l_discount) AS vf_max, min(l_extendedprice) AS price_min, max(l_tax) AS tax_max, 'quadratic' AS element_order FROM lineitem""")
def dataset_manifest(t):
    m = sinks.manifest(t.lineitem, ["l_extendedprice", "l_tax"], "l_discount", element_order="quadratic")
    return m.select("n_rows", "vf_min", "vf_max", F.col("label_min.l_extendedprice").alias("price_min"), F.col("label_max.l_tax").alias("tax_max"), "element_order")


_SIX = "(ax * (dy * cz - dz * cy) + ay * (dz * cx - dx * cz) + az * (dx * cy - dy * cx)) / 6"


@query("stl_ascii_triangles", f"WITH {TRI}, {FACE} SELECT count(*) AS n_tris, round(sum({_SIX}), 4) AS volume, round(sum(area), 4) AS area, round(max(dx), 6) AS right FROM f")
def stl_ascii_triangles(t):
    """All mesh triangles written as ASCII files and read back by byte ranges of 50 kB."""
    base = f"{ensure_checkpoint_dir(t.spark)}/stl-{uuid.uuid4().hex}"
    stl.write_ascii(meshes(t.part), base)
    rows = stl.read_triangles(stl.list_stl(t.spark, base, names="part-*"), chunk=1000)
    six = vec.dot("v0", vec.cross("v1", "v2")) / 6.0
    area = vec.norm(vec.cross(vec.sub("v1", "v0"), vec.sub("v2", "v0"))) / 2.0
    return rows.where("error IS NULL").agg(F.count_distinct("path", "tri_id").alias("n_tris"), F.round(F.sum(six), 4).alias("volume"), F.round(F.sum(area), 4).alias("area"), F.round(F.max("v1.x"), 6).alias("right"))


@query("stl_heads", "SELECT 'OK (ascii)' AS reason, true AS ok")
def stl_heads(t):
    """Mesh files checked by size and head (S5); the file names are the writer's, so reasons are counted once."""
    base = f"{ensure_checkpoint_dir(t.spark)}/stl-{uuid.uuid4().hex}"
    stl.write_ascii(meshes(t.part), base)
    return stl.check_stl(t.spark, base, names="part-*").select("reason", "ok").distinct()
