"""Structured Streaming: run results into the versioned master, and ingest rates (ST1-ST3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from trabecula.sources.master import commit_rows, commits

KEYS = ["Run", "Batch"]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _usable(status: str | None) -> bool:
    return status is None or str(status).startswith("OK")


class VersionRuns(StatefulProcessor):
    """W6 per Run: numbers its new batches v(n+1), where n counts the usable results so far; a batch that was seen is dropped.

    State: the usable results so far (value) and the batches seen (map). Of a delivery one row per batch is held, a usable one before any other.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.usable = handle.getValueState("usable", "n long")
        self.seen = handle.getMapState("seen", "batch string", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best: dict[str, tuple] = {}
        for row in rows:
            batch, status = row["Batch"], row["Status"]
            rank = (not _usable(status), "OK" if status is None else str(status))
            if batch not in best or rank < best[batch][0]:
                best[batch] = (rank, row)
        state, make = self.usable.get(), Row(*self.columns, "Version")
        n = state[0] if state else 0
        given, named, met = n, key[0] not in (None, ""), set()
        for batch in sorted(best, key=lambda b: (b is not None, b or "")):
            if (batch or "") in met or state and self.seen.containsKey((batch or "",)):  # a new run has seen none before
                continue
            met.add(batch or "")
            row, given = best[batch][1], given + 1
            self.seen.updateValue((batch or "",), (given,))
            n += named and row["Status"] is not None and _usable(row["Status"])
            yield make(*[row[c] for c in self.columns], f"v{given}")
        self.usable.update((n,))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """One row per known batch of a master that was there before the stream: Run, Batch, n (1 if usable)."""
        n = self.usable.get()[0] if self.usable.exists() else 0
        self.seen.updateValue((initialState["Batch"] or "",), (0,))
        self.usable.update((n + initialState["n"],))

    def close(self) -> None:
        pass


def versioned(results: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The new rows of a stream of run results with their Version. `initial` (Run, Batch, Status): rows of an older master, read once at the very start."""
    schema = T.StructType([*results.schema.fields, T.StructField("Version", T.StringType())])
    start = None
    if initial is not None:
        ok = F.coalesce(F.col("Status"), F.lit("")).startswith("OK") & (F.coalesce(F.col("Run"), F.lit("")) != "")
        start = initial.select("Run", F.col("Batch").cast("string").alias("Batch"), F.when(ok, 1).otherwise(0).cast("long").alias("n")).groupBy("Run")
    return results.groupBy("Run").transformWithState(VersionRuns(results.columns), schema, "Append", "None", start)


def ingest_runs(results: DataFrame, master_path: str, checkpoint: str, available_now: bool = True, initial: DataFrame | None = None) -> StreamingQuery:
    """ST1: stream of run results (Run, Batch, Status, ...) into the master.

    Versions and seen batches live in the stream's state, so no micro-batch reads the master. A micro-batch is one commit named after the
    checkpoint and its number: delivered again it changes nothing, and a half-written one is replaced.
    """
    spark, name = results.sparkSession, hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def commit(batch: DataFrame, number: int) -> None:
        own = f"{name}-{number:09d}"
        if own not in {r["commit"] for r in commits(batch.sparkSession, master_path)}:
            commit_rows(batch, master_path, own, KEYS)

    rows = versioned(results.withColumn("Batch", F.col("Batch").cast("string")), initial)
    w = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the query keeps the setting it starts with
    try:
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def read_run_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Folder of result files as a stream."""
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def ingest_rate(stream: DataFrame, ts: str, keys: list[str], window: str = "1 hour", slide: str | None = None,
                delay: str = "10 minutes") -> DataFrame:
    """ST2: rows per tumbling (or sliding) event-time window; works on a stream and on a table alike."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    agg = stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("window.start").alias("window_start"), *keys, "n")


def drop_repeats(stream: DataFrame, ts: str, keys: list[str] = ("Run", "Batch"), delay: str = "1 hour") -> DataFrame:
    """ST3: a repeated delivery inside the watermark is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
