"""Sharding over fixed virtual slots.

Records hash by id and content into a fixed number of virtual slots, so that null or repeated ids do not gather in one; bytes are summed per slot; a versioned slot-to-shard map is
laid by those sums, stored as a table, and edited, never rebuilt, when shards are added or have grown uneven. Only the slot sums (a bounded number) reach the driver.

Cases: null text has no bytes, a null id hashes by its text alone, rows of the same id and text share a slot and have places of their own, an empty table gives an empty result.
Extra columns are not read."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

N_SLOTS = 4096
#: Bytes that a record costs besides its text.
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Version and shard of each virtual slot."""

    version: int
    n_shards: int
    shards: tuple[int, ...] = field(repr=False)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "n_shards": self.n_shards, "shards": list(self.shards)})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        x = json.loads(text)
        return SlotMap(x["version"], x["n_shards"], tuple(x["shards"]))


def slot_of(id_col: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """By the first 60 bits of an md5 of id and content, which any language can compute."""
    name = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.crc32(F.coalesce(text, F.lit(""))))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def store(spark: SparkSession, slots: SlotMap) -> DataFrame:
    """(map_version, virtual_slot, shard), written to the shared folder."""
    return cut(spark.createDataFrame([(slots.version, i, s) for i, s in enumerate(slots.shards)], "map_version int, virtual_slot int, shard int"))


def load(table: DataFrame, n_shards: int | None = None) -> SlotMap:
    """The map of a stored table, its latest version; shards that hold no slot are counted by n_shards."""
    rows = table.collect()
    version = max(r[0] for r in rows)
    shards = [s for _, s in sorted((r[1], r[2]) for r in rows if r[0] == version)]
    return SlotMap(version, n_shards or max(shards) + 1, tuple(shards))


def slot_bytes(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: n_slots rows at most."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + OVERHEAD
    return {r[0]: (r[1], r[2]) for r in docs.groupBy(slot_of(F.col(id_col), F.col(text_col), n_slots).alias("s")).agg(F.sum(size), F.count(F.lit(1))).collect()}


def first_map(sums: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Largest slot first, each to the lightest shard; ties by number, so reruns agree."""
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda x: (-sums.get(x, 0), x)):
        load, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (load + sums.get(slot, 0), shard))
    return SlotMap(1, n_shards, tuple(shards))


def rebalance(old: SlotMap, sums: dict[int, int], n_shards: int | None = None, slack: float = 0.02) -> SlotMap:
    """The next version: slots move one by one from the heaviest shard to the lightest (new shards start empty), and only while that
    narrows the gap and the heaviest is above the mean by more than the slack. All other slots stay where they are."""
    n = n_shards or old.n_shards
    if n < old.n_shards:
        raise ValueError("shards can be added, not taken away")
    shards, loads = list(old.shards), [0] * n
    held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for slot, shard in enumerate(shards):
        loads[shard] += sums.get(slot, 0)
        held[shard].append((sums.get(slot, 0), slot))
    for x in held:
        x.sort()
    mean = sum(loads) / n
    while True:
        top, low = max(range(n), key=lambda s: (loads[s], -s)), min(range(n), key=lambda s: (loads[s], s))
        gap = loads[top] - loads[low]
        fit = [i for i, (b, _) in enumerate(held[top]) if 0 < b < gap]
        if loads[top] <= mean * (1 + slack) or not fit:
            return SlotMap(old.version + 1, n, tuple(shards))
        i = min(fit, key=lambda i: (abs(gap / 2 - held[top][i][0]), held[top][i][1]))
        size, slot = held[top].pop(i)
        held[low].append((size, slot))
        held[low].sort()
        loads[top] -= size
        loads[low] += size
        shards[slot] = low


def assign(docs: DataFrame, slots: SlotMap, counts: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot (place in its shard, gapless from 0), virtual_slot, map_version.

    Places are numbered per virtual slot, a small and even share of the rows, and offset by the rows of the shard's earlier slots: no shard is ever one task."""
    start, offsets = [0] * slots.n_shards, []
    for s, shard in enumerate(slots.shards):
        offsets.append(start[shard])
        start[shard] += counts.get(s, 0)
    table = docs.sparkSession.createDataFrame([(s, slots.shards[s], offsets[s]) for s in range(len(offsets))], "virtual_slot int, shard int, ahead long")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), slot_of(F.col(id_col), text, len(offsets)).alias("virtual_slot"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(id_col), "text_crc32", "size")).cast("long") - 1
    placed = rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot")
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("place")).alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"))


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay the first map over the table's slot sums, store it, and assign every row by what is stored."""
    sums = slot_bytes(docs, n_slots, id_col, text_col)
    stored = store(docs.sparkSession, first_map({s: b for s, (b, _) in sums.items()}, n_shards, n_slots))
    return assign(docs, load(stored, n_shards), {s: n for s, (_, n) in sums.items()}, id_col, text_col)
