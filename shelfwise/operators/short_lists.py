"""The k best dot products where every dimension of the index is short, without shuffling pairs.

Queries are sorted by their heaviest dimension, so that alike ones lie together, and cut into
blocks. Each list of a dimension goes once to every block that asks for it; a task adds up the
products of one block after the other and keeps the k best of each query. What is sent is at
most the entries of the joined pairs and, where queries that share dimensions lie together, not
much more than the index.

Where all ids are compared with one another, ``nearest_of_all`` goes without vectors in long form:
an id is one stored row with its entries as they came, its dimensions are shuffled once, and a list
is sent with marks of who asks. Copies need no class there, since a short list bounds them, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.blocks import DECIMALS, MAX_TASKS
from shelfwise.operators.ids import ordinal_ids
from shelfwise.session import cut_lineage, stored

#: Queries of a block at most, pairs of a block on average at most, products expanded at once.
QUERIES, PAIRS, EXPANSION = 4096, 8_000_000, 2_000_000
#: The same of a comparison of all with all, whose blocks hold each list once.
ALL_QUERIES = 16_384
#: Entries of one of its lists at most.
LONGEST = 10_000


def short_top_k(queries: DataFrame, index: DataFrame, k: int, pairs: float, block: int | None = None) -> DataFrame:
    """``(qid, vid, sim)`` as ``similarity.top_k``; ``pairs`` is the number of joined entries."""
    heaviest = queries.groupBy("id").agg(F.max_by("dim", F.struct("w", "dim")).alias("heaviest"))
    numbered = cut_lineage(ordinal_ids(heaviest, [F.col("heaviest"), F.col("id")], "number"))
    asking = numbered.count()
    block = block or int(min(QUERIES, max(1, PAIRS * asking / max(pairs, 1))))
    placed = queries.join(numbered.select("id", F.floor(F.col("number") / block).alias("block")), "id")
    asked = placed.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "w")).alias("q"))
    lists = index.groupBy("dim").agg(F.collect_list(F.struct("id", "w")).alias("v"))
    sent = asked.join(lists, "dim").select(
        "block", F.col("q.id").alias("q_ids"), F.col("q.w").alias("q_ws"), F.col("v.id").alias("v_ids"), F.col("v.w").alias("v_ws"))
    q_type, v_type = (side.schema["id"].dataType.simpleString() for side in (queries, index))
    tasks = min(MAX_TASKS, 2 * (asking // block) + 1)
    dealt = sent.repartition(tasks, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(lambda batches: _answers(batches, k, best_of), f"qid {q_type}, vid {v_type}, sim double")


def nearest_of_all(
    entries: DataFrame, k: int, short_list: int, cells_per_pair: float, heavy: int, block: int | None = None,
) -> DataFrame | None:
    """``(qid, vid, sim, rank)`` of the k nearest of every id by cosine, from entries ``(id, dim, x)`` with x above zero.

    None where this is not the way: an entry meets more than ``short_list`` others on average, a list is longer than
    ``LONGEST``, an id has more than ``heavy`` entries, or comparing blocks costs less. Pass a stored table.
    """
    lengths = entries.where("dim is not null").groupBy("dim").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sizes = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    longest, pairs, met, largest, asking = (
        lengths.agg(F.max("n").alias("longest"), F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("met"))
        .crossJoin(sizes.agg(F.max("n").alias("largest"), F.count(F.lit(1)).alias("asking"))).first()
    )
    if not pairs or pairs > short_list * met or longest > LONGEST or largest > heavy or asking ** 2 <= cells_per_pair * pairs:
        return None
    block = block or int(min(ALL_QUERIES, max(1, PAIRS * asking / pairs)))
    rows = entries.groupBy("id").agg(F.collect_list(F.struct("x", "dim")).alias("e")).select(
        "id", "e", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, c: a + c["x"] * c["x"])).alias("norm"), F.array_max("e")["dim"].alias("heaviest"))
    # Numbers within a sorted part: ids of the same block lie side by side.
    placed = stored(rows.orderBy("heaviest", "id").withColumn("block", F.floor(F.monotonically_increasing_id() / block)).drop("heaviest"), "placed")
    entry = placed.select("id", "block", "norm", F.explode("e").alias("e")).where("e.dim is not null")
    lists = entry.groupBy(F.col("e.dim").alias("dim")).agg(
        F.collect_list(F.struct("id", (F.col("e.x") / F.col("norm")).alias("w"), "block")).alias("l")).where(F.size("l") > 1)
    sent = lists.select("l", F.explode(F.array_distinct("l.block")).alias("block")).select(
        "block", F.col("l.id").alias("ids"), F.col("l.w").alias("ws"), F.transform("l.block", lambda b: b == F.col("block")).alias("asks"))
    kind = entries.schema["id"].dataType.simpleString()
    dealt = sent.repartition(min(MAX_TASKS, 2 * (asking // block) + 1), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(lambda batches: _answers(batches, k, best_of_marked), f"qid {kind}, vid {kind}, sim double, rank int")


def _answers(batches: Iterator[pa.RecordBatch], k: int, best: Callable[[pa.Table, int], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The lists of each block, whose rows come one after the other."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high == low:
                continue
            if held and block[low] != current:
                yield from best(pa.Table.from_batches(held).combine_chunks(), k)
                held = []
            current = block[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield from best(pa.Table.from_batches(held).combine_chunks(), k)


def best_of(rows: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query of rows ``(q_ids, q_ws, v_ids, v_ws)``, one a dimension."""
    q_lists, v_lists = rows.column("q_ids").chunk(0), rows.column("v_ids").chunk(0)
    q_sizes, v_sizes = (np.diff(x.offsets.to_numpy()) for x in (q_lists, v_lists))
    q_ids, v_ids = (x.flatten().to_numpy(zero_copy_only=False) for x in (q_lists, v_lists))
    q_ws, v_ws = (rows.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("q_ws", "v_ws"))
    ids, codes = np.unique(np.concatenate([q_ids, v_ids]), return_inverse=True)
    dim = np.repeat(np.arange(len(q_sizes)), q_sizes)
    kinds = [rows.schema.field(c).type.value_type for c in ("q_ids", "v_ids")]
    for asks, found, sims, _ in _best(codes[:len(q_ids)], q_ws, dim, codes[len(q_ids):], v_ws, v_sizes, len(ids), k):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[asks], kinds[0]), pa.array(ids[found], kinds[1]), pa.array(sims)], ["qid", "vid", "sim"])


def best_of_marked(rows: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The same with ranks, of rows ``(ids, ws, asks)``: one list a dimension, with marks of those that ask."""
    lists = rows.column("ids").chunk(0)
    sizes, named = np.diff(lists.offsets.to_numpy()), lists.flatten()
    ids, codes = np.unique(named.to_numpy(zero_copy_only=False), return_inverse=True)
    ws, asks = (rows.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("ws", "asks"))
    asking = np.flatnonzero(asks)
    dim = np.repeat(np.arange(len(sizes)), sizes)[asking]
    for asked, found, sims, rank in _best(codes[asking], ws[asking], dim, codes, ws, sizes, len(ids), k):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[asked], named.type), pa.array(ids[found], named.type), pa.array(sims), pa.array(rank, pa.int32())],
            ["qid", "vid", "sim", "rank"])


def _best(q, q_ws, dim, v, v_ws, v_sizes, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of queries and found, similarities and ranks; ``dim`` says which list of ``v`` an entry of ``q`` asks for."""
    order = np.argsort(q, kind="stable")
    q, q_ws, dim = q[order], q_ws[order], dim[order]
    v_start = np.cumsum(v_sizes) - v_sizes
    matches = v_sizes[dim]
    # Cut between queries, so that a part has some EXPANSION products or one query.
    first = np.flatnonzero(np.append(True, np.diff(q) != 0)) if len(q) else np.zeros(0, np.int64)
    before = (np.cumsum(matches) - matches)[first] // EXPANSION
    starts = first[np.append(True, np.diff(before) != 0)] if len(first) else first
    for low, high in zip(starts, np.append(starts[1:], len(q)), strict=True):
        met = matches[low:high]
        entry = np.repeat(np.arange(low, high), met)
        other = np.repeat(v_start[dim[low:high]] - (np.cumsum(met) - met), met) + np.arange(met.sum())
        cell = q[entry] * n + v[other]
        products = q_ws[entry] * v_ws[other]
        order = np.argsort(cell, kind="stable")
        cell, products = cell[order], products[order]
        new = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        sims = np.round(np.add.reduceat(products, new), DECIMALS) if len(new) else np.zeros(0)
        asks, found = np.divmod(cell[new], n)
        keep = asks != found
        asks, found, sims = asks[keep], found[keep], sims[keep]
        cuts = np.flatnonzero(np.diff(asks)) + 1
        best = [a + _first_k(sims[a:b], k) for a, b in zip([0, *cuts], [*cuts, len(asks)], strict=True)]
        at = np.concatenate(best) if best else np.zeros(0, np.int64)
        rank = np.concatenate([np.arange(1, len(places) + 1) for places in best]) if best else at
        yield asks[at], found[at], sims[at], rank


def _first_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, ties by place."""
    if len(sims) > k:
        near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
    else:
        near = np.arange(len(sims))
    return near[np.lexsort((near, -sims[near]))][:k]
