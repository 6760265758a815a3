"""Sharding by fixed virtual slots (native).

Records are hashed into thousands of slots that never change; a stored map says
which shard holds each slot.  The map is a table of versions: growing, and
rebalancing by the bytes in each slot, append the edited slots alone, so only
their rows move, and any earlier version can be read again.

Defined results: a null ``doc_id`` hashes as its own key; a null text has 0
bytes and the CRC of no bytes; a text of any length is one record; repeated rows
are rows of their own, in the same slot; an empty table gives no rows; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.llm.common import materialise, ranked, scratch_dir
from famloom.sources.store import Store

#: Virtual slots; a power of two, far above the number of shards.
SLOTS = 4096
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def slot_of(key: str, slots: int = SLOTS):
    """A record's virtual slot: md5, so that other engines find the same."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long") % slots


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt to shards in turn."""
    return [s % shards for s in range(slots)]


def grown(mapping: list[int], shards: int) -> list[int]:
    """The map for one shard more: it takes its part evenly from all others, and nothing else moves."""
    out, keep = list(mapping), len(mapping) // (shards + 1)
    held = [[s for s, at in enumerate(out) if at == k] for k in range(shards)]
    for _ in range(keep):
        k = max(range(shards), key=lambda i: (len(held[i]), -i))
        out[held[k].pop()] = shards
    return out


def rebalanced(mapping: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The map with slots moved from the fullest to the emptiest shard while that lessens the larger of the two.

    ``slot_bytes`` has a number for each slot: its size is bounded by the number of slots.
    """
    out = list(mapping)
    load = [0] * shards
    for s, k in enumerate(out):
        load[k] += slot_bytes.get(s, 0)
    mean = sum(load) / shards
    for _ in range(len(out)):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        moves = [s for s, k in enumerate(out) if k == hi and 0 < slot_bytes.get(s, 0) < gap]
        if gap <= tolerance * mean or not moves:
            break
        s = min(moves, key=lambda x: (abs(gap / 2 - slot_bytes[x]), x))
        out[s], load[hi], load[lo] = lo, load[hi] - slot_bytes[s], load[lo] + slot_bytes[s]
    return out


class SlotMap:
    """The stored map: versions from 1 in a folder, each of the slots it edits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path, "slot")

    def _append(self, slots: dict[int, int]) -> int:
        return self.store.write(self.spark.createDataFrame(sorted(slots.items()), "slot int, shard int").coalesce(1))

    def create(self, shards: int, slots: int = SLOTS) -> int:
        return self._append(dict(enumerate(first_map(shards, slots))))

    def table(self, version: int | None = None) -> DataFrame:
        """slot, shard as of a version; a row for each slot."""
        return self.store.read(version)

    def shards(self, version: int | None = None) -> list[int]:
        """The shard of each slot: as many numbers as there are slots."""
        return [r["shard"] for r in self.table(version).sort("slot").collect()]

    def edit(self, after: list[int]) -> int:
        """A version in which the slots that differ are as in ``after``; nothing else is written."""
        return self._append({s: k for s, (k, was) in enumerate(zip(after, self.shards(), strict=True)) if k != was})

    def grow(self, shards: int) -> int:
        """One shard more than ``shards``: it takes slots, and no other shard does."""
        return self.edit(grown(self.shards(), shards))

    def rebalance(self, records: DataFrame, shards: int, tolerance: float = 0.01) -> int:
        """Slots moved by the bytes they hold (a row for each slot comes to the driver)."""
        held = {r["virtual_slot"]: r["slot_bytes"] for r in slot_bytes(records).collect()}
        return self.edit(rebalanced(self.shards(), held, shards, tolerance))


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each record; no text is carried on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        slot_of("doc_id", slots).cast("int").alias("virtual_slot"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard under version 1 of the map, under version 2, which has one shard more, and under version 3, rebalanced by bytes.

    Law ``key``: doc_id and the number of shards decide ``shard`` and
    ``grown_shard``.  ``slot`` is the record's place in its shard, gapless from 0;
    ``virtual_slot`` the fixed slot, ``slot_bytes`` what that slot holds,
    ``balanced_shard`` where version 3 has it.  ``path``: a new folder for the map.
    """
    spark = docs.sparkSession
    known = SlotMap(spark, path or f"{scratch_dir(spark)}/slots-{uuid.uuid4().hex}")
    placed = materialise(sized(docs, slots).withColumn("__u", F.monotonically_increasing_id()), "records")
    known.create(shards, slots)
    known.grow(shards)
    known.rebalance(placed, shards + 1)
    names = {1: "shard", 2: "grown_shard", 3: "balanced_shard"}
    maps = [known.table(v).select(F.col("slot").alias("virtual_slot"), F.col("shard").alias(n)) for v, n in names.items()]
    # The slot tables have at most `slots` rows.
    every = reduce(lambda a, b: a.join(b, "virtual_slot"), maps).join(slot_bytes(placed), "virtual_slot")
    placed = placed.join(F.broadcast(every), "virtual_slot")
    order = [F.col(c) for c in ("shard", "virtual_slot", "doc_id", "text_crc32", "__u")]
    out = ranked(placed, order, "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes", "balanced_shard")
