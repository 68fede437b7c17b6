"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot never changes; shards own slots. Bytes are aggregated per slot
(a table of at most ``n_slots`` rows, whatever the corpus), and only the map is
edited when shards are added or drift apart.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql import Window as W

from echoframe.session import materialize

N_SLOTS = 4096
#: Rows that are alike are numbered in steps of so many.
STEP = 1 << 16
#: How far from the mean a shard may stay.
SLACK = 0.001
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def virtual_slot(*key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``; a null text counts as empty.

    The key is the id together with length and checksum of the text, and for
    rows alike in all of these their number among them, so rows without an id,
    many rows under one id and equal rows still spread. Rows alike are counted
    where they are read and numbered out again from the counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    keys = ("doc_id", "size", "text_crc32")
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return number_out(counted, *keys).withColumn(
        "virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("nth"), n_slots=n_slots)
    ).drop("nth")


def number_out(counted: DataFrame, *keys: str) -> DataFrame:
    """``n`` rows ``nth = 0, 1, ...`` of each counted row. Large counts are dealt out in steps before they are numbered."""
    numbers = lambda low, high: F.explode(F.sequence(low, high))
    zero, last = F.lit(0).cast("long"), F.col("n") - 1
    few = counted.filter(F.col("n") <= STEP).select(*keys, numbers(zero, last).alias("nth"))
    parts = counted.filter(F.col("n") > STEP).select(*keys, "n", numbers(zero, F.floor(last / STEP)).alias("step")).repartition("step", *keys)
    begin = F.col("step") * STEP
    return few.union(parts.select(*keys, numbers(begin, F.least(begin + (STEP - 1), last)).alias("nth")))


def slot_sizes(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most ``n_slots`` rows on the driver."""
    rows = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["virtual_slot"], r["b"], r["n"]) for r in rows)


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Slots to shards in turn, before anything is known of the rows."""
    return {slot: slot % n_shards for slot in range(n_slots)}


def assign(sizes: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """Slot -> shard: the largest slot goes to the lightest shard; unused slots in turn."""
    heap = [(0, shard) for shard in range(n_shards)]
    owner = {}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    for i, slot in enumerate(s for s in range(n_slots) if s not in owner):
        owner[slot] = i % n_shards
    return owner


def rebalance(owner: dict[int, int], sizes: list[tuple[int, int, int]], n_shards: int, slack: float = SLACK) -> dict[int, int]:
    """An edited map for ``n_shards``: slots move from heavy shards to light ones only.

    Slots of shards that no longer exist move first. A slot moves only where
    that lowers the larger of the two loads; stops when every shard is within
    ``slack`` of the mean or no move helps.
    """
    weight = {slot: size for slot, size, _ in sizes}
    new = dict(owner)
    load = [0] * n_shards
    homeless = []
    for slot, shard in new.items():
        if shard < n_shards:
            load[shard] += weight.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-weight.get(s, 0), s)):
        shard = min(range(n_shards), key=lambda s: (load[s], s))
        new[slot], load[shard] = shard, load[shard] + weight.get(slot, 0)
    held: list[list[int]] = [[] for _ in range(n_shards)]
    for slot, shard in new.items():
        if weight.get(slot, 0):
            held[shard].append(slot)
    mean = sum(load) / n_shards
    while True:
        light = min(range(n_shards), key=lambda s: (load[s], s))
        heavy = max(range(n_shards), key=lambda s: (load[s], -s))
        if load[heavy] - load[light] <= slack * mean:
            return new
        gap = load[heavy] - load[light]
        fitting = [s for s in held[heavy] if weight[s] < gap]
        if not fitting:
            return new
        slot = min(fitting, key=lambda s: (abs(2 * weight[s] - gap), s))
        held[heavy].remove(slot)
        held[light].append(slot)
        load[heavy] -= weight[slot]
        load[light] += weight[slot]
        new[slot] = light


def save_map(spark: SparkSession, path: str, owner: dict[int, int], sizes: list[tuple[int, int, int]], version: int) -> str:
    """Store one version; earlier versions stay. Returns the folder of the version."""
    size = {slot: (b, n) for slot, b, n in sizes}
    rows = [(version, slot, shard, *size.get(slot, (0, 0))) for slot, shard in sorted(owner.items())]
    at = f"{path}/version-{version:06d}"
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(at)
    return at


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The named version, or the latest one."""
    versions = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version-*")
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def has_map(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def edit_map(spark: SparkSession, path: str, sizes: list[tuple[int, int, int]], n_shards: int, n_slots: int = N_SLOTS) -> int:
    """Edit the latest map under ``path`` for the present slot sizes and store the next version; returns its number.

    Where there is no map yet, version 1 deals the slots out in turn, and as no
    shard holds anything, the edit may move any slot. Later edits move few.
    """
    fresh = not has_map(spark, path)
    if fresh:
        save_map(spark, path, first_map(n_shards, n_slots), [], 1)
    latest = load_map(spark, path).select("version", "slot", "shard").collect()  # a row per slot
    version = latest[0]["version"] + 1
    owner = {r["slot"]: r["shard"] for r in latest}
    if fresh:
        best = assign(sizes, n_shards, n_slots)
        new = owner | {slot: best[slot] for slot, _, _ in sizes}
    else:
        new = rebalance(owner, sizes, n_shards)
    save_map(spark, path, new, sizes, version)
    return version


def shard_documents(docs: DataFrame, map_path: str, n_shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, slot`` for every row.

    Bytes of all rows are aggregated per virtual slot, the latest map under
    ``map_path`` (or a first one) is edited by them, stored as the next version
    and applied as stored; only slots that a heavy shard gives to a light one
    move. ``slot`` numbers the rows of a shard from 0 without gaps: the rows
    before a virtual slot within its shard come from the map, the rest is a row
    number inside the virtual slot, so no shard passes through one task. Texts
    are read once and never shuffled. Null texts have size 1 and checksum 0;
    null ids and repeated rows are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slotted = materialize(with_slots(docs, n_slots), "sharding-rows")
    version = edit_map(spark, map_path, slot_sizes(slotted), n_shards, n_slots)
    return apply_map(slotted, load_map(spark, map_path, version))


def apply_map(slotted: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and place in the shard by a stored map; the map has ``n_slots`` rows, so it is broadcast."""
    before = W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slot_map.select(
        F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    )
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("place")).cast(Ty.LongType()).alias("slot"))
    )
