"""Shards from fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspark.llm.common import stored

SLOTS = 4096
# A text whose copies weigh more than this part of a shard's fair share is dealt out by doc_id, in parts no heavier than a slot's
# fair share.
HOT = 0.5
# Rows of a slot that one task numbers.
NUMBERED = 10_000


class Slot(NamedTuple):
    """A virtual slot: hash slot, part of it (0 unless it was split), bytes and rows."""

    slot: int
    part: int
    size: int
    rows: int


def record_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def hash_slot(text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: equal texts have the same one."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(slots)).cast("int")


def new_map(weights: list[Slot], shards: int) -> dict[tuple[int, int], int]:
    """Slot to shard, heaviest slot first, each to the shard with the fewest bytes so far."""
    return rebalanced({}, weights, shards)


def rebalanced(old: dict[tuple[int, int], int], weights: list[Slot], shards: int) -> dict[tuple[int, int], int]:
    """The next version of a map: only slots that are new, or whose shard is too full or gone, move.

    A shard gives up slots, lightest last, until it holds its fair share at most; these and the new slots then go
    to the emptiest shards, heaviest first."""
    fair = sum(w.size for w in weights) / shards
    filled, moving, mapped = [0] * shards, [], {}
    for w in sorted(weights, key=lambda w: (-w.size, w)):
        shard = old.get((w.slot, w.part), shards)
        if shard < shards and filled[shard] + w.size <= fair:
            filled[shard] += w.size
            mapped[w.slot, w.part] = shard
        else:
            moving.append(w)
    heap = [(size, shard) for shard, size in enumerate(filled)]
    heapq.heapify(heap)
    for w in moving:
        size, shard = heapq.heappop(heap)
        mapped[w.slot, w.part] = shard
        heapq.heappush(heap, (size + w.size, shard))
    return mapped


def slot_weights(slotted: DataFrame) -> list[Slot]:
    """Bytes and rows per virtual slot: as many rows as there are slots, whatever the input."""
    rows = slotted.groupBy("hash_slot", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    return [Slot(r["hash_slot"], r["part"], r["size"], r["rows"]) for r in rows]


def map_table(spark: SparkSession, version: int, mapped: dict[tuple[int, int], int], weights: list[Slot]) -> DataFrame:
    """The map as a table: version, hash_slot, part, shard, first_place, the rows of the shard before the slot, and salts, the
    tasks that number the slot's rows."""
    counts = {(w.slot, w.part): w.rows for w in weights}
    ahead: dict[int, int] = {}
    lines = []
    for (slot, part), shard in sorted(mapped.items()):
        salts = -(-counts[slot, part] // NUMBERED)
        lines.append(f"({version}, {slot}, {part}, {shard}, {ahead.get(shard, 0)}L, {salts})")
        ahead[shard] = ahead.get(shard, 0) + counts[slot, part]
    columns = "version, hash_slot, part, shard, first_place, salts"
    if not lines:
        return spark.sql(f"SELECT {columns} FROM VALUES (0, 0, 0, 0, 0L, 0) AS t({columns}) WHERE false")
    return spark.sql(f"SELECT {columns} FROM VALUES {', '.join(lines)} AS t({columns})")


def read_map(stored_maps: DataFrame, version: int | None = None) -> dict[tuple[int, int], int]:
    """Slot to shard of a version (default: the newest) of a stored map, for the next call of `sharded`. The map has a row per slot
    and part, whatever the data."""
    if version is None:
        version = stored_maps.agg(F.max("version")).first()[0]
    rows = stored_maps.where(F.col("version") == F.lit(version)).select("hash_slot", "part", "shard").collect()
    return {(r["hash_slot"], r["part"]): r["shard"] for r in rows}


def _split(slotted: DataFrame, weights: list[Slot], shards: int, slots: int) -> DataFrame:
    """Rows of too heavy texts dealt out by doc_id, in parts from 1; all other texts of their slots stay in part 0.

    There are at most `shards / HOT` such texts, in as many slots at most; only those slots are looked at text by text."""
    total = sum(w.size for w in weights)
    hot = [w.slot for w in weights if w.size > HOT * total / shards]
    texts = slotted.where(F.col("hash_slot").isin(hot)).groupBy("hash_slot", "text_hash").agg(F.sum("size").alias("size"))
    chosen, before = F.lit(0), dict.fromkeys(hot, 0)
    for r in texts.where(F.col("size") > HOT * total / shards).sort("hash_slot", "text_hash").collect():
        count = -(-r["size"] * slots // total)
        spread = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(count)).cast("int") + 1 + before[r["hash_slot"]]
        before[r["hash_slot"]] += count
        chosen = F.when(F.col("text_hash") == r["text_hash"], spread).otherwise(chosen)
    return slotted.withColumn("part", chosen)


def sharded(
    docs: DataFrame, shards: int, slots: int = SLOTS, old: dict[tuple[int, int], int] | None = None, version: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(rows, map): doc_id, size, text_crc32, shard, slot (place in the shard, gapless from 0), hash_slot, part;
    and the stored slot-to-shard map. With `old`, the map edits that one.

    Records are hashed by text into `slots` fixed slots, so equal texts share a shard. Only the copies of a text that
    weighs more than HOT of a shard's fair share are torn apart, by doc_id, as shards could not be near equal
    otherwise; whatever else lies in its slot stays together. The driver sees slots only, never rows; rows of a slot
    are numbered by as many tasks as they need and their counts added up, so no task holds a shard or a slot of many small rows.
    Null texts count as empty; texts of any length are hashed whole; null ids sort first; rows that are equal in all columns get
    places in any order; an empty table gives an empty map. Other columns than doc_id and text are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slotted = docs.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        hash_slot(F.col("text"), slots).alias("hash_slot"),
        F.xxhash64(text).alias("text_hash"),
        F.lit(0).alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    slotted = stored(slotted, "slotted")
    weights = slot_weights(slotted)
    total = sum(w.size for w in weights)
    if any(w.size > HOT * total / shards for w in weights):
        slotted = _split(slotted, weights, shards, slots)
        weights = slot_weights(slotted)
    mapped = rebalanced(old or {}, weights, shards)
    table = stored(map_table(docs.sparkSession, version, mapped, weights), "slot-map")
    # The map has at most slots + slots / HOT rows.
    placed = slotted.join(F.broadcast(table), ["hash_slot", "part"])
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))
    spot = ["hash_slot", "part", "salt"]
    place = F.row_number().over(Window.partitionBy(*spot).orderBy("doc_id", "text_crc32", "size", "row"))
    ahead = Window.partitionBy("hash_slot", "part").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*spot).agg(F.count("*").alias("n"))
    counts = counts.select(*spot, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    rows = placed.withColumn("_place", place).join(counts, spot)
    slot = (F.col("first_place") + F.col("ahead") + F.col("_place") - 1).alias("slot")
    return rows.select("doc_id", "size", "text_crc32", "shard", slot, "hash_slot", "part"), table
