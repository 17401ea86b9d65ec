"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, thousands for a few dozen shards; bytes are summed by slot, and a small
map says which shard holds each slot. The map has versions: growing, shrinking or rebalancing edits a copy of it, so only
the records of the slots that moved change their shard. Records never look at anything but the map.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table, text_of
from .numbering import positions

#: Slots: fixed for the life of a dataset, also the bound of every table that the driver or a broadcast holds.
SLOTS, SHARDS, OVERHEAD = 8192, 40, 16
#: How far above the mean a shard may be, as a share, before an edit takes slots from it.
SLACK = 0.01


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot, as of a version."""

    version: int
    shards: int
    shard: tuple[int, ...]


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (bytes of the text and ``OVERHEAD``), text_crc32, virtual_slot, of every row, written.

    A null text has no bytes. The slot is a hash of the id, the crc32 and the size, so null and repeated ids with
    different texts spread; rows repeated in full share a slot."""
    data = text_of(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")
    return cut(rows.withColumn("virtual_slot", slot), "records")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes of each slot; the driver gets one number a slot."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).toArrow()
    out = np.zeros(slots, np.int64)
    out[found["virtual_slot"].to_numpy()] = found["bytes"].to_numpy()
    return out


def _dealt(shard: np.ndarray, todo: list[int], size: np.ndarray, shards: int) -> None:
    """Give each slot of ``todo``, large ones first, to the shard with the fewest bytes, then the fewest slots."""
    held, count = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
    placed = shard >= 0
    np.add.at(held, shard[placed], size[placed])
    np.add.at(count, shard[placed], 1)
    heap = [(int(held[k]), int(count[k]), k) for k in range(shards)]
    heapq.heapify(heap)
    for s in sorted(todo, key=lambda s: (-int(size[s]), s)):
        b, c, k = heapq.heappop(heap)
        shard[s] = k
        heapq.heappush(heap, (b + int(size[s]), c + 1, k))


def first_map(size: np.ndarray, shards: int = SHARDS) -> SlotMap:
    """A map of equal shards over slots with these bytes; no shard is above the mean by more than the largest slot."""
    shard = np.full(len(size), -1, np.int64)
    _dealt(shard, list(range(len(size))), size, shards)
    return SlotMap(1, shards, tuple(shard.tolist()))


def edited(old: SlotMap, size: np.ndarray, shards: int, slack: float = SLACK) -> SlotMap:
    """The next version of a map, for today's bytes and this many shards. Slots of shards that are gone move, and of
    shards above the mean by more than ``slack`` those slots, large ones first, that bring them down to it without
    going below; all others stay where they are. While no slot has bytes, each new shard gets an equal part of the slots."""
    shard = np.array(old.shard)
    shard[shard >= shards] = -1
    mean = int(size.sum()) / shards
    for k in range(shards):
        mine = np.flatnonzero(shard == k)
        over = int(size[mine].sum()) - mean
        if over <= mean * slack:
            continue
        for s in mine[np.argsort(-size[mine], kind="stable")].tolist():
            if 0 < size[s] <= over:
                shard[s] = -1
                over -= int(size[s])
    if (new := shards - old.shards) > 0 and not size.any():  # nothing is stored yet: shards with the most slots give some
        mine = [np.flatnonzero(shard == k).tolist() for k in range(old.shards)]
        for n in range(new * (len(shard) // shards)):
            shard[max(mine, key=len).pop()] = old.shards + n % new
    _dealt(shard, np.flatnonzero(shard < 0).tolist(), size, shards)
    return SlotMap(old.version + 1, shards, tuple(shard.tolist()))


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the maps at ``path``; a version that is there is replaced, others stay."""
    rows = [(slot_map.shards, slot, shard) for slot, shard in enumerate(slot_map.shard)]
    spark.createDataFrame(rows, "shards int, slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map at ``path``, the latest one without a number."""
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    found = sorted((r.slot, r.shard, r.shards) for r in rows.where(F.col("version") == version).collect())
    if not found:
        raise ValueError(f"no map of version {version} at {path}")
    return SlotMap(int(version), found[0][2], tuple(s for _, s, _ in found))


def with_shard(rows: DataFrame, slot_map: SlotMap, name: str = "shard") -> DataFrame:
    """``rows`` with the shard of their slot. The map that is broadcast has one row a slot, whatever the rows are."""
    pairs = rows.sparkSession.createDataFrame([*enumerate(slot_map.shard)], f"virtual_slot int, `{name}` int")
    return rows.join(F.broadcast(pairs), "virtual_slot")


def sharded(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """What ``records`` gives, with shard and slot (place in the shard, from 0 without gaps; by virtual slot, then id,
    null first, then crc32 and size). Rows that repeat in full are places of their own; empty in, empty out.

    Skew: places are numbered by ranges over all tasks, so neither a large shard nor a large slot meets in one."""
    rows = with_shard(rows, slot_map)
    order = ["virtual_slot", "doc_id", "text_crc32", "size"]
    return positions(rows, "shard", order, "sharded").withColumnRenamed("pos", "slot").drop("n")


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes; next_shard is theirs in version 2 of the map, which has 41."""
    rows = records(table(spark, sf_dir, "documents"))
    size, path = slot_bytes(rows), f"{shared_dir(spark)}/maps"
    write_map(spark, first_map(size), path)
    write_map(spark, edited(read_map(spark, path), size, SHARDS + 1), path)
    first, second = read_map(spark, path, 1), read_map(spark, path)
    return with_shard(sharded(rows, first), second, "next_shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard",
    )


QUERIES = {"op13_virtual_slots": op13_virtual_slots}
ORACLE_SQL: dict[str, str] = {}
