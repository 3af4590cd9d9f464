"""Sharding by fixed virtual slots: records are hashed into thousands of slots, bytes are summed per slot, and a
versioned slot-to-shard map says where each slot lives. Rebalancing edits the map, never the hash."""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from hotelspark.llm.common import settled, shared_folder

SLOTS = 4096
RECORD_BYTES = 16


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), one row per document.

    The slot is a hash of the id. Rows without an id are spread by their place in the input, so many of them, even
    with equal or null texts, fill many slots; the place is only stable once the rows are settled, as
    ``shard_documents`` does before weighing. Null text counts as empty. Repeated rows with an id share a slot.
    Other columns are not carried.
    """
    text = F.coalesce("text", F.lit(""))
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return docs.select(
        "doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", spread), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_weights(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot. The driver gets one row per slot, however large the table is."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()
    return {s: (b, n) for s, b, n in found}


def first_map(weights: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Largest slot first, each onto the shard with the fewest bytes so far. Empty slots are dealt in turn."""
    load = [(0, s) for s in range(shards)]
    placed = {}
    for slot, (size, _) in sorted(weights.items(), key=lambda x: (-x[1][0], x[0])):
        total, shard = heapq.heappop(load)
        placed[slot] = shard
        heapq.heappush(load, (total + size, shard))
    return {s: placed.get(s, s % shards) for s in range(slots)}


def rebalance(current: dict[int, int], weights: dict[int, tuple[int, int]], shards: int, spread: float = 0.001) -> dict[int, int]:
    """An edited copy of the map: slots move one at a time from the fullest to the emptiest shard until the two are
    within ``spread`` of the mean or no move narrows the gap. Shards beyond the map's start empty; slots of shards
    that are gone move first."""
    size = {s: weights.get(s, (0, 0))[0] for s in current}
    edited, held, total = {}, [set() for _ in range(shards)], [0] * shards
    for slot, shard in current.items():
        if shard < shards:
            edited[slot] = shard
            held[shard].add(slot)
            total[shard] += size[slot]
    for slot in sorted(set(current) - set(edited), key=lambda s: (-size[s], s)):
        _place(slot, min(range(shards), key=lambda s: (total[s], s)), edited, held, total, size)
    allowed = spread * sum(total) / shards
    while True:
        high, low = max(range(shards), key=lambda s: total[s]), min(range(shards), key=lambda s: total[s])
        gap = total[high] - total[low]
        fits = [s for s in held[high] if 0 < size[s] < gap]
        if gap <= allowed or not fits:
            return edited
        slot = min(fits, key=lambda s: (abs(gap - 2 * size[s]), s))
        held[high].remove(slot)
        total[high] -= size[slot]
        _place(slot, low, edited, held, total, size)


def _place(slot, shard, edited, held, total, size) -> None:
    edited[slot] = shard
    held[shard].add(slot)
    total[shard] += size[slot]


def write_map(spark: SparkSession, path: str, version: int, placed: dict[int, int], weights: dict[int, tuple[int, int]]) -> None:
    """Add one version of the map to the table at ``path``; earlier versions stay as they are."""
    rows = [(s, shard, *weights.get(s, (0, 0))) for s, shard in sorted(placed.items())]
    spark.createDataFrame(rows, "virtual_slot int, shard int, slot_bytes long, slot_rows long").coalesce(1).write.parquet(
        f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest unless told."""
    versions = spark.read.parquet(path)
    wanted = versions.agg(F.max("version")).first()[0] if version is None else version
    return versions.filter(F.col("version") == wanted)


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every document with its shard, its virtual slot, the map's version and its gapless place in the shard.

    Two versions of the map are kept at ``path`` (a new folder in the shared one unless told): the first build and
    its rebalanced edit, which is the one in force. The map has ``slots`` rows, so it is broadcast. Places are the
    rows of the shard's earlier slots plus the rank within the slot, so no task ever holds a shard.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = settled(slotted(docs, slots))
    weights = slot_weights(rows)
    built = first_map(weights, shards, slots)
    write_map(spark, path, 1, built, weights)
    write_map(spark, path, 2, rebalance(built, weights, shards), weights)
    placed = read_map(spark, path).withColumn(
        "first", F.coalesce(F.sum("slot_rows").over(
            Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + rank - 1).alias("slot"), "virtual_slot",
        F.col("version").alias("map_version"))
