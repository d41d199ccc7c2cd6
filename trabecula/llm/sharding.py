"""Fixed virtual slots: records hash into slots, slots are assigned to shards by a versioned map.

A record's slot never changes; only the slot-to-shard map does. Balancing and growing move whole slots, and every
map edit is a new version, so any earlier placement can be read back.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trabecula.llm.common import cut, table

#: Virtual slots. The map has one row per slot, so it stays this small at any input size.
SLOTS = 8192
MAP_SCHEMA = "version long, slot int, shard int, bytes long"


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    """Bytes and rows of each slot, combined before the shuffle."""
    return records.groupBy(slot).agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def build_map(spark: SparkSession, stats: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map: slots by falling bytes, each to the shard with fewest bytes so far. At most `slots` rows are read."""
    sizes = {r["virtual_slot"]: r["bytes"] for r in stats.select("virtual_slot", "bytes").collect()}
    load = [(0, s) for s in range(shards)]
    rows = []
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        total, shard = heapq.heappop(load)
        rows.append((0, slot, shard, sizes.get(slot, 0)))
        heapq.heappush(load, (total + sizes.get(slot, 0), shard))
    return spark.createDataFrame(rows, MAP_SCHEMA)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of the map."""
    return versions.where(F.col("version") == versions.agg(F.max("version")).first()[0])


def rebalance(versions: DataFrame, stats: DataFrame, shards: int, tolerance: float = 0.01) -> DataFrame:
    """All versions plus one more, for `shards` shards and the bytes now in each slot.

    Slots of removed shards and slots above the tolerated load move, largest first, to the emptiest shard; the others stay.
    Growing by one shard therefore moves slots into the new shard only.
    """
    spark = versions.sparkSession
    sizes = {r["virtual_slot"]: r["bytes"] for r in stats.select("virtual_slot", "bytes").collect()}
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    homeless, version = [], 0
    for r in latest(versions).collect():
        version = r["version"]
        item = (sizes.get(r["slot"], 0), r["slot"])
        (held[r["shard"]] if r["shard"] < shards else homeless).append(item)
    mean = sum(sizes.values()) / shards
    for own in held.values():
        own.sort()
        load = sum(b for b, _ in own)
        over = load - mean
        for item in [x for x in reversed(own) if x[0]]:
            if load - item[0] >= mean and over > tolerance * mean:
                own.remove(item)
                homeless.append(item)
                load -= item[0]
                over = load - mean
    queue = [(sum(b for b, _ in own), s) for s, own in held.items()]
    heapq.heapify(queue)
    for size, slot in sorted(homeless, reverse=True):
        load, shard = heapq.heappop(queue)
        held[shard].append((size, slot))
        heapq.heappush(queue, (load + size, shard))
    rows = [(version + 1, slot, shard, size) for shard, own in held.items() for size, slot in own]
    return versions.unionByName(spark.createDataFrame(rows, MAP_SCHEMA))


def place(records: DataFrame, slot_map: DataFrame, order: list[str], slot: str = "virtual_slot", stats: DataFrame | None = None) -> DataFrame:
    """Adds `shard` and `place`, the record's gapless position in its shard.

    Positions are counted inside a virtual slot and shifted by the rows of the shard's earlier slots, so no task holds a whole shard.
    """
    counts = slot_bytes(records, slot) if stats is None else stats
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(counts.select(F.col(slot).alias("slot"), "rows"), "slot").select(
        F.col("slot").alias(slot), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(slot).orderBy(*order)
    return (records.withColumn("__rn", F.row_number().over(inside).cast("long")).join(starts, slot)
            .withColumn("place", F.col("__start") + F.col("__rn") - 1).drop("__start", "__rn"))


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Documents placed by the `bytes` law: doc_id, size, text_crc32, virtual_slot, shard, place.

    Size is the UTF-8 bytes of the text plus 8; a null text has none and counts 8. A null doc_id and repeated doc_ids are placed
    like other records (equal ids share a slot). An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = cut(docs.select("doc_id", (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
                              slot_of(F.col("doc_id"), slots).alias("virtual_slot")))
    stats = cut(slot_bytes(records))
    return place(records, build_map(spark, stats, shards, slots), ["doc_id", "text_crc32", "size"], stats=stats)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
