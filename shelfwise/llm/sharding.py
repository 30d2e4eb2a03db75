"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VIRTUAL`` points of a ring of ``SLOTS`` slots. A key belongs to the first
point clockwise of its hash. No shard takes more than its capacity: keys that find it full
go on clockwise to the next point whose shard has room. With a load factor of one the
capacities are the row count dealt out evenly, so the counts differ by one at most (the law
``rows``); a larger factor moves fewer keys and leaves more play.

Rows are never gathered by shard. Counts per ring slot are a map-side aggregate; from the
counts of the arcs between points, bounded by the number of points, the driver works out
which run of each arc's ranks goes to which shard. A row's rank in its arc is its cell's
first rank plus its number within the cell, a cell being a part of a ring slot of bounded
size. Repeated doc_ids are spread over the parts of their slot by a stored salt.

Defined results: a null text has no bytes and size 1; null doc_ids are keys like any other;
repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

SHARDS = 16
VIRTUAL = 64
SLOTS = 1 << 14
#: Rows numbered by one task at a time, about.
CELL = 100_000


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(slot, shard) of all points, in ring order. A shard's points do not depend on the others."""
    points = {}
    for shard in range(shards):
        for k in range(virtual):
            digest = hashlib.blake2b(f"{shard}:{k}".encode(), digest_size=8).digest()
            points.setdefault(int.from_bytes(digest, "big") % SLOTS, shard)  # the lower shard keeps a shared slot
    return sorted(points.items())


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard may take: with factor one the rows dealt out evenly."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load_factor * rows / shards)] * shards


def allot(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): arcs fill their owner, the rest goes on clockwise."""
    left, room, used, taken = list(counts), list(room), [0] * len(room), [0] * len(counts)
    out = []
    for hop in range(len(owners)):
        if not any(left):
            break
        for arc in range(len(owners)):
            shard = owners[(arc + hop) % len(owners)]
            n = min(left[arc], room[shard])
            if n:
                out.append((arc, taken[arc], taken[arc] + n, shard, used[shard]))
                taken[arc] += n
                left[arc] -= n
                room[shard] -= n
                used[shard] += n
    return out


def shard_rows(documents: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, load_factor: float = 1.0, cell: int = CELL) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    text = F.col("text").cast("string")
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - (SLOTS.bit_length() - 1)).cast("int")
    rows = stored(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
        .withColumn("ring_slot", slot)
        .withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")), "shard-rows")
    total = rows.count()
    points = ring(shards, virtual)
    slots, owners = [p[0] for p in points], [p[1] for p in points]
    # Slots after the last point wrap around to the first.
    arcs = documents.sparkSession.createDataFrame([(s, bisect_left(slots, s) % len(slots)) for s in range(SLOTS)], "ring_slot int, arc int")
    by_slot = rows.groupBy("ring_slot").count()
    # A slot's parts follow its own size, so a repeated doc_id is split like any other hot slot.
    by_slot = stored(by_slot.join(F.broadcast(arcs), "ring_slot").withColumn("parts", F.ceil(F.col("count") / cell).cast("int")), "shard-slots")
    parts = by_slot.select("ring_slot", "arc", "parts")  # SLOTS rows at most
    cells = rows.join(F.broadcast(parts), "ring_slot").withColumn("part", F.pmod(F.xxhash64("doc_id", "salt"), F.col("parts")).cast("int"))
    before = Window.partitionBy("arc").orderBy("ring_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(
        cells.groupBy("arc", "ring_slot", "part").count()
        .withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).select("ring_slot", "part", "first"), "shard-cells")
    counts = {r["arc"]: r["n"] for r in by_slot.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    runs = allot([counts.get(a, 0) for a in range(len(points))], owners, capacities(total, shards, load_factor))
    runs = documents.sparkSession.createDataFrame(runs, "arc int, from_rank long, to_rank long, shard int, from_slot long")
    within = Window.partitionBy("ring_slot", "part").orderBy("doc_id", "salt", "size", "text_crc32")
    ranked = (
        cells.withColumn("number", F.row_number().over(within)).join(firsts, ["ring_slot", "part"])
        .withColumn("rank", F.col("first") + F.col("number") - 1)
    )
    inside = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    return (
        # An arc is one run but for those at which some shard fills up: points + shards * points rows at the very most.
        ranked.join(F.broadcast(runs), "arc").where(inside)
        .select("doc_id", "size", "text_crc32", "shard", (F.col("from_slot") + F.col("rank") - F.col("from_rank")).alias("slot"))
    )
