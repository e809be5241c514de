"""Sharding (operator 6) over fixed virtual slots.

Records are hashed into thousands of slots; the bytes of every slot are added
up; a versioned map gives each slot its shard.  Rebalancing edits the map: it
moves whole slots, no record is hashed anew.  The law that holds is ``bytes``.

A record's slot comes from its id, size, text checksum and copy number, so rows
without id, of one repeated id, or equal in everything spread over all slots.
The only things that reach the driver are one row a slot (at most ``SLOTS``).
Defined cases: a null text has no bytes (size 1); equal rows are numbered as
copies of one record; an empty table gives an empty table and leaves the map as
it is; extra columns are not carried, join on the id for them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storelens.llm.common import keep

SLOTS = 16384


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map; ``shards[slot]`` is the slot's shard."""

    version: int
    n_shards: int
    shards: tuple[int, ...]
    note: str = ""
    parent: int | None = field(default=None)

    @staticmethod
    def even(n_shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, n_shards, tuple(s % n_shards for s in range(slots)), "even")

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, size in sizes.items():
            out[self.shards[slot]] += size
        return out

    def gap(self, sizes: dict[int, int]) -> int:
        """Bytes between the fullest and the emptiest shard."""
        load = self.loads(sizes)
        return max(load) - min(load)

    def edited(self, sizes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The rebalanced next version if it is more even or has other shards, else this one."""
        new = self.rebalance(sizes, n_shards)
        return new if new.n_shards != self.n_shards or new.gap(sizes) < self.gap(sizes) else self

    def rebalance(self, sizes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """The next version, with near equal bytes in ``n_shards`` shards.

        Shards above the mean give slots away, largest that fits first; the
        freed slots go, largest first, to the emptiest shard; then single slots
        move or swap between the fullest and the emptiest shard while that narrows the gap.
        """
        n = n_shards or self.n_shards
        owner = [s if s < n else None for s in self.shards]
        held: list[list[int]] = [[] for _ in range(n)]
        for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
            if owner[slot] is not None:
                held[owner[slot]].append(slot)
        load = [sum(sizes[s] for s in h) for h in held]
        mean = sum(sizes.values()) / n
        free = [s for s in sizes if owner[s] is None]
        for shard in range(n):
            for slot in list(held[shard]):
                if load[shard] - sizes[slot] >= mean:
                    held[shard].remove(slot)
                    load[shard] -= sizes[slot]
                    free.append(slot)
        for slot in sorted(free, key=lambda s: (-sizes[s], s)):
            shard = min(range(n), key=lambda k: (load[k], k))
            held[shard].append(slot)
            load[shard] += sizes[slot]
        for _ in range(64 * n):
            high, low = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            best = min(((abs(gap - 2 * sizes[s]), s) for s in held[high] if 0 < sizes[s] < gap), default=None)
            if best is None or best[0] >= gap:
                break
            held[high].remove(best[1])
            held[low].append(best[1])
            load[high] -= sizes[best[1]]
            load[low] += sizes[best[1]]
        for shard, slots in enumerate(held):
            for slot in slots:
                owner[slot] = shard
        # a slot without records stays where it was, unless its shard is gone
        shards = tuple(s % n if k is None else k for s, k in enumerate(owner))
        moved = sum(a != b for a, b in zip(self.shards, shards, strict=True))
        return SlotMap(self.version + 1, n, shards, f"moved {moved} slots", self.version)


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot of ``rows`` (virtual_slot, size): at most ``SLOTS`` rows on the driver."""
    got = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in got}


def _versions(folder: str) -> str:
    return f"{folder.rstrip('/')}/slot_map"


def save_map(spark: SparkSession, folder: str, m: SlotMap) -> None:
    """Write a version into the map's folder (one JSON row; a version written again replaces itself, others stay)."""
    row = json.dumps({"version": m.version, "n_shards": m.n_shards, "shards": m.shards, "note": m.note, "parent": m.parent})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{_versions(folder)}/version={m.version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
    """A stored version of the map, the latest by default; None if there is none."""
    try:
        stored = spark.read.text(_versions(folder))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    got = stored.where(F.col("version") == version).first()  # one row, of one folder
    if got is None:
        return None
    pick = json.loads(got["value"])
    return SlotMap(pick["version"], pick["n_shards"], tuple(pick["shards"]), pick["note"], pick["parent"])


def records(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row; equal rows are counted
    before the shuffle and told apart by their copy number after it."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("text_crc32"), F.col("copy")]
    return copies.select("doc_id", "size", "text_crc32", slot_of(*key, slots=slots).alias("virtual_slot"))


def assign(docs: DataFrame, n_shards: int = 16, slots: int = SLOTS, slot_map: SlotMap | None = None,
           doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, SlotMap]:
    """Every record's shard under a map balanced by bytes, and the map.

    Columns: doc_id, size, text_crc32, virtual_slot, shard, place (the record's
    number within its shard, gapless from 0), map_version.  A given ``slot_map`` is the
    version that gets edited; it stays as it is where an edit narrows no gap.
    """
    spark = docs.sparkSession
    rows = keep(records(docs, slots, doc_id, text), lasting=True)
    sizes = slot_sizes(rows)
    m = (slot_map or SlotMap.even(n_shards, slots)).edited({s: b for s, (b, _) in sizes.items()}, n_shards)
    start, offset = [0] * m.n_shards, [0] * slots
    for s in range(slots):  # where the slot's records begin within the shard
        offset[s] = start[m.shards[s]]
        start[m.shards[s]] += sizes.get(s, (0, 0))[1]
    table = spark.createDataFrame([(s, m.shards[s], offset[s]) for s in range(slots)], "virtual_slot int, shard int, start long")
    # one row a slot: at most SLOTS rows, some 400 kB
    joined = rows.join(F.broadcast(table), "virtual_slot")
    by = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return joined.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.row_number().over(by) - 1).alias("place"),
                         F.lit(m.version).alias("map_version")), m


def reshard(docs: DataFrame, folder: str, n_shards: int = 16, **columns: str) -> DataFrame:
    """``assign`` under the latest map stored in ``folder``: edited where that makes
    the shards more even, and then stored as the next version."""
    spark = docs.sparkSession
    last = load_map(spark, folder)
    rows, m = assign(docs, n_shards, slots=len(last.shards) if last else SLOTS, slot_map=last, **columns)
    if m != last:
        save_map(spark, folder, m)
    return rows
