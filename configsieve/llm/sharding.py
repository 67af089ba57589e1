"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of the record and never changes.  Bytes are summed
per slot, and slots are given to shards by size, so shard sizes come out near
equal.  The map (one row per slot, thousands in all) is stored in versions;
rebalancing reads the newest one, edits it for the bytes and the number of shards
there are now, moving as few slots as it can, and stores it as the next.  No
record moves whose slot stays.

Groups of equal texts are not kept together: a slot goes by id and text, so the
law is that of `bytes` alone, and a text with thousands of copies fills no shard.

Edge cases: a null text has no bytes and the checksum of an empty text; equal
rows share a slot and get places of their own; an empty table gives an empty
result, and leaves a stored map as it is but for shards that are gone; other
columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from configsieve.llm.storage import new_path, settled

SLOTS = 4096
SHARDS = 40
ROW_BYTES = 16
#: Rows of one slot that one task numbers.
PLACE_ROWS = 20_000


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return narrow.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: at most one entry per slot."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*"))
    return {slot: (size, n) for slot, size, n in sums.collect()}


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slots first, each to the shard with the fewest bytes; empty slots in turn."""
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        size, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + max(loads.get(slot, 0), 1), shard))
    return out


def rebalanced(current: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for new loads or another number of shards.

    Slots of removed shards must move.  Beyond that, a slot moves from the
    fullest to the emptiest shard as long as that narrows the gap between the
    two; where there are new shards, only they take slots.
    """
    out = dict(current)
    totals = dict.fromkeys(range(shards), 0)
    members: dict[int, set[int]] = {shard: set() for shard in range(shards)}
    homeless = []
    for slot, shard in out.items():
        if shard < shards:
            totals[shard] += loads.get(slot, 0)
            members[shard].add(slot)
        else:
            homeless.append(slot)

    def move(slot: int, to: int) -> None:
        out[slot] = to
        totals[to] += loads.get(slot, 0)
        members[to].add(slot)

    for slot in sorted(homeless, key=lambda s: (-loads.get(s, 0), s)):
        move(slot, min(totals, key=lambda s: (totals[s], s)))
    takers = [shard for shard in totals if not members[shard]] or list(totals)
    while True:
        full = max(totals, key=lambda s: (totals[s], -s))
        empty = min(takers, key=lambda s: (totals[s], s))
        gap = totals[full] - totals[empty]
        fits = [s for s in members[full] if 0 < loads.get(s, 0) < gap]
        if not fits:
            return out
        slot = min(fits, key=lambda s: (abs(gap - 2 * loads[s]), s))
        members[full].remove(slot)
        totals[full] -= loads[slot]
        move(slot, empty)


def write_map(spark: SparkSession, path: str, slot_map: dict[int, int], version: int) -> None:
    """Store one version; an existing version is never overwritten."""
    rows = spark.createDataFrame(sorted(slot_map.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def placed(rows: DataFrame, loads: dict[int, tuple[int, int]], slot_map: DataFrame) -> DataFrame:
    """The records with their shard and their place in it, gapless from 0.

    A place is the rows of the slots before in the shard, plus those of the
    buckets before in the slot, plus the row's number in its bucket; a bucket
    holds about PLACE_ROWS, so no task numbers a whole shard.
    """
    spark = rows.sparkSession
    counts = spark.createDataFrame(
        [(slot, n, -(-n // PLACE_ROWS)) for slot, (_, n) in loads.items()], "virtual_slot int, n long, n_buckets long"
    )
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.join(slot_map, "virtual_slot").select(
        "virtual_slot", "shard", "n_buckets", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slot_base")
    )
    # One row per virtual slot: thousands, by construction.
    dealt = rows.join(F.broadcast(slots), "virtual_slot")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("text_crc32", "doc_id", F.lit(7)), "n_buckets"))
    sizes = dealt.groupBy("virtual_slot", "bucket").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("virtual_slot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("virtual_slot", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("bucket_base"))
    number = F.row_number().over(Window.partitionBy("virtual_slot", "bucket").orderBy("doc_id", "text_crc32")) - 1
    # Dealt by both columns: a join could else reuse the window's dealing by slot alone.
    bases = bases.repartition("virtual_slot", "bucket")
    joined = dealt.withColumn("number", number).join(bases, ["virtual_slot", "bucket"])
    return joined.withColumn("place", F.col("slot_base") + F.col("bucket_base") + F.col("number"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard all documents by bytes; the first map is stored as version 0 under `map_path`."""
    spark = docs.sparkSession
    rows = settled(slotted(docs, slots), "slotted")
    loads = slot_loads(rows)
    path = map_path or new_path(spark, "slot-map")
    write_map(spark, path, first_map({s: size for s, (size, _) in loads.items()}, shards, slots), 0)
    return placed(rows, loads, read_map(spark, path, 0))


def newest_version(spark: SparkSession, path: str) -> int:
    """The number of the last stored map."""
    maps = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    return maps.agg(F.max("version")).first()[0]


def reshard_documents(docs: DataFrame, map_path: str, shards: int = SHARDS) -> DataFrame:
    """Place all documents by the newest map under `map_path`, edited for their bytes and for `shards`.

    The edited map is stored as the next version; one that another job has stored
    meanwhile is not overwritten, and this job fails.  `previous_shard` is where a
    record's slot was before; it differs from `shard` for the records that move.
    """
    spark = docs.sparkSession
    version = newest_version(spark, map_path)
    before = read_map(spark, map_path, version)
    current = {r["virtual_slot"]: r["shard"] for r in before.collect()}  # one row per slot
    rows = settled(slotted(docs, len(current)), "slotted")
    loads = slot_loads(rows)
    write_map(spark, map_path, rebalanced(current, {s: size for s, (size, _) in loads.items()}, shards), version + 1)
    out = placed(rows, loads, read_map(spark, map_path, version + 1))
    return out.join(F.broadcast(before.withColumnRenamed("shard", "previous_shard")), "virtual_slot")
