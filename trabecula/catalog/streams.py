"""Streaming queries over the events table (ST2, ST3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trabecula.catalog.registry import query
from trabecula.session import ensure_checkpoint_dir
from trabecula.sources import sinks, tables
from trabecula.streaming import ingest


def _drain(stream, spark):
    """Run a stream over all present data into a Parquet folder next to the checkpoints and read that back."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).withColumn("ts", F.col("ts").cast("timestamp"))


@query("ingest_rate", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ingest_rate(t):
    out = ingest.ingest_rate(t.events, "ts", ["event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query("ingest_rate_sliding", "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - s.k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS start_at, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY 1")
def ingest_rate_sliding(t):
    out = ingest.ingest_rate(t.events, "ts", [], "1 hour", "30 minutes")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start_at"), "n")


@query("stream_ingest_rate", """SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, count(*) AS n FROM events GROUP BY 1)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_ingest_rate(t):
    """Windows the watermark has closed once the stream has read everything."""
    out = _drain(ingest.ingest_rate(_stream(t), "ts", []), t.spark)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


@query("stream_drop_repeats", "SELECT count(*) AS n FROM events")
def stream_drop_repeats(t):
    """Every event is delivered twice; the repeat is dropped."""
    twice = _stream(t).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return _drain(ingest.drop_repeats(twice, "ts", ["event_id"]), t.spark).agg(F.count(F.lit(1)).alias("n"))


_EVENT_RUNS = """e AS (SELECT 'u' || user_id AS Run, strftime(ts, '%Y%m%d') AS Batch, CASE WHEN event_type IN ('click', 'view') THEN 'OK' ELSE 'ERROR ' || event_type END AS Status FROM events),
k AS (SELECT Run, Batch, arg_min(Status, (CASE WHEN Status LIKE 'OK%' THEN 0 ELSE 1 END, Status)) AS Status FROM e GROUP BY 1, 2)"""


def _event_runs(events):
    ok = F.col("event_type").isin("click", "view")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("Run"), F.date_format("ts", "yyyyMMdd").alias("Batch"),
                         F.when(ok, "OK").otherwise(F.concat(F.lit("ERROR "), "event_type")).alias("Status"))


@query("stream_master", f"WITH {_EVENT_RUNS} SELECT Batch, Status, count(*) AS n, count(DISTINCT Run) AS n_runs, sum(CAST(v AS BIGINT))::BIGINT AS versions FROM (SELECT *, row_number() OVER (PARTITION BY Run ORDER BY Batch) AS v FROM k) GROUP BY 1, 2")
def stream_master(t):
    """Events replayed as run results, with usable and failed rows of one key, into the versioned master (ST1)."""
    base = f"{ensure_checkpoint_dir(t.spark)}/master-{uuid.uuid4().hex}"
    ingest.ingest_runs(_event_runs(_stream(t)), f"{base}/table", f"{base}/state").awaitTermination()
    rows = sinks.read_master(t.spark, f"{base}/table").withColumn("v", F.substring("Version", 2, 9).cast("long"))
    return rows.groupBy(F.col("Batch").cast("string").alias("Batch"), "Status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Run").alias("n_runs"), F.sum("v").alias("versions"))


@query("append_master", f"WITH {_EVENT_RUNS} SELECT Batch, Status, count(*) AS n FROM k GROUP BY 1, 2")
def append_master(t):
    """The same rows appended as a table, and once more without effect (K2)."""
    base = f"{ensure_checkpoint_dir(t.spark)}/master-{uuid.uuid4().hex}"
    rows = _event_runs(t.events)
    sinks.append_master(rows, base)
    again = sinks.append_master(rows, base)
    return again.groupBy(F.col("Batch").cast("string").alias("Batch"), "Status").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_round_trip", "SELECT p_brand AS topology, count(*) AS n, round(sum(p_size / 60), 6) AS vf FROM part GROUP BY 1")
def dataset_round_trip(t):
    """The parts written as a sorted CSV dataset and scanned with an explicit schema."""
    path = f"{ensure_checkpoint_dir(t.spark)}/dataset-{uuid.uuid4().hex}"
    sinks.write_dataset(t.part.select(F.col("p_brand").alias("topology"), (F.col("p_size") / 60).alias("VF")), path, fmt="csv")
    back = tables.read_csv(t.spark, path, "topology string, VF double")
    return back.groupBy("topology").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("VF"), 6).alias("vf"))


@query("lookup_round_trip", "SELECT count(*) AS n, round(sum(p_size / 60), 6) AS density, round(sum(p_retailprice), 2) AS t FROM part")
def lookup_round_trip(t):
    """A lookup written as CSV and scanned."""
    path = f"{ensure_checkpoint_dir(t.spark)}/lookup-{uuid.uuid4().hex}"
    t.part.select((F.col("p_size") / 60).alias("density"), F.col("p_retailprice").alias("t"), F.lit(None).cast("double").alias("vf_actual")).write.option("header", True).csv(path)
    return tables.read_lookup(t.spark, path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("density"), 6).alias("density"), F.round(F.sum("t"), 2).alias("t"))
