"""The k best dot products between two tables of vectors, block against block under bounds.

Vectors are rows ``(id, dims, ws)``. They are sorted by norm and by their heaviest
dimension, so that alike ones lie together, and packed into blocks of bounded size, one row
each. A block carries an envelope: for every bucket of (dimension, sign) the greatest norm
that the part of one of its vectors in that bucket has. By the Cauchy-Schwarz inequality a
dot product is at most the sum of the products of both norms over the buckets.

Every query block first meets the ``SEEDS`` index blocks with the highest bounds, best
first. Its k-th best results then decide which other index blocks can still change anything:
only those are sent to it. Neighbouring query blocks form a group, and an index block is sent
once to a group, so that what is sent is some ``GROUPS`` times the index rather than its square.
Inside a task the running k-th best skips further blocks. What a task holds is one group of
query blocks, one index block and k results a query; results of a query are ranked where they
were found, so no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import scratch_path

BLOCK_IDS, BLOCK_ENTRIES = 1024, 100_000
#: Numbers of an envelope; a driver holds the envelopes of at most MAX_BLOCKS blocks (32 MB), larger tables get larger blocks.
ENVELOPE, MAX_BLOCKS = 64, 65_536
SEEDS = 16
#: Groups of query blocks that are aimed at, and query blocks of a group at most.
GROUPS, GROUP_BLOCKS = 32, 32
#: Tasks of a comparison at most; each takes whole query blocks.
MAX_TASKS = 10_000
DECIMALS = 9
# Dimensions per dense slab, products expanded at once.
SLAB, EXPANSION = 2048, 4_000_000


def rows_of(vectors: DataFrame) -> DataFrame:
    """``(id, dims, ws)`` from long form ``(id, dim, w)``."""
    entry = F.collect_list(F.struct("dim", "w"))
    return vectors.groupBy("id").agg(entry.alias("e")).select("id", F.col("e.dim").alias("dims"), F.col("e.w").alias("ws"))


def dense_rows(vectors: DataFrame, values: Column) -> DataFrame:
    """``(id, dims, ws)`` from an array column of fixed length."""
    numbers = F.sequence(F.lit(0), F.size("ws") - 1)
    return vectors.select("id", values.cast("array<double>").alias("ws")).select("id", numbers.alias("dims"), "ws")


def bucket_norms(rows: np.ndarray, dims: np.ndarray, ws: np.ndarray, n: int) -> np.ndarray:
    """Norm of each vector's part in each bucket of (dimension, sign)."""
    hashed = pd.util.hash_array(np.asarray(dims)) if len(dims) else np.zeros(0, np.uint64)
    bucket = (hashed + np.where(ws < 0, np.uint64(ENVELOPE // 2), np.uint64(0))) % np.uint64(ENVELOPE)
    squares = np.bincount(rows * ENVELOPE + bucket.astype(np.int64), ws * ws, minlength=n * ENVELOPE)
    return np.sqrt(squares.reshape(n, ENVELOPE))


def _pack(batches: Iterator[pa.RecordBatch], most_ids: int, most_entries: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks of consecutive ones."""
    held: list[pa.RecordBatch] = []
    ids = entries = 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        dims, ws = (rows.column(c).combine_chunks() for c in ("dims", "ws"))
        sizes = np.diff(ws.offsets.to_numpy())
        numbers = np.repeat(np.arange(len(rows)), sizes)
        dims, ws = dims.flatten(), ws.flatten()
        envelope = bucket_norms(numbers, dims.to_numpy(zero_copy_only=False), ws.to_numpy(zero_copy_only=False), len(rows)).max(0)

        def one(values) -> pa.Array:
            return pa.ListArray.from_arrays([0, len(values)], values)

        return pa.RecordBatch.from_arrays(
            [one(rows.column("id").combine_chunks()), one(pa.array(sizes, pa.int32())), one(dims), one(ws), one(pa.array(envelope))],
            ["ids", "sizes", "dims", "ws", "envelope"])

    for batch in batches:
        sizes = np.diff(batch.column("ws").offsets.to_numpy())
        start = 0
        for at, size in enumerate(sizes):
            ids, entries = ids + 1, entries + int(size)
            if ids >= most_ids or entries >= most_entries:
                held.append(batch.slice(start, at + 1 - start))
                yield block()
                held, start, ids, entries = [], at + 1, 0, 0
        if start < len(batch):
            held.append(batch.slice(start))
    if held:
        yield block()


def packed(rows: DataFrame, ids: int = BLOCK_IDS, entries: int = BLOCK_ENTRIES, most: int = MAX_BLOCKS) -> DataFrame:
    """Stored blocks ``(block, ids, sizes, dims, ws, envelope)`` of ``(id, dims, ws)``."""
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("ws", F.lit(0.0), lambda a, x: a + x * x))
    size = F.transform("ws", lambda x: F.abs(x))
    heaviest = F.try_element_at("dims", F.greatest(F.array_position(size, F.array_max(size)), F.lit(1)).cast("int"))
    order = [F.round(F.log2(F.greatest(norm, F.lit(1e-300)))).desc(), heaviest, F.col("id")]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"ids array<{types['id']}>, sizes array<int>, dims {types['dims']}, ws {types['ws']}, envelope array<double>"
    path = scratch_path(spark, "blocks")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        sorted_rows.mapInArrow(lambda batches: _pack(batches, ids, entries), schema)
        .withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    )
    blocks = spark.read.schema(f"{schema}, block long").parquet(path)
    made = blocks.count()
    if made > most:
        return packed(rows, ids * (1 + made // most), entries * (1 + made // most), most)
    return blocks


class IndexBlock:
    """An index block; its entries are sorted by dimension once, whatever number of query blocks it meets."""

    def __init__(self, ids, sizes, dims, ws, envelope):
        self.ids, self.envelope, self._rows = np.asarray(ids), np.asarray(envelope), (sizes, np.asarray(dims), np.asarray(ws, float))

    @cached_property
    def _tile(self):
        sizes, dims, ws = self._rows
        names, cols = np.unique(dims, return_inverse=True)
        return names, _by_column(np.repeat(np.arange(len(self.ids)), sizes), cols, ws)

    def tile_of(self, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries in the given sorted dimensions, numbered as these are."""
        names, (rows, cols, values) = self._tile
        cols = pd.Index(dims).get_indexer(names)[cols]
        known = cols >= 0
        return (rows, cols, values) if known.all() else (rows[known], cols[known], values[known])


class QueryBlock:
    """A block of queries and their k best results so far; ``skipped`` counts index blocks that a bound ruled out."""

    def __init__(self, ids, sizes, dims, ws, k: int, positive_only: bool, exclude_same: bool):
        self.ids, self.k, self.positive_only, self.exclude_same = np.asarray(ids), k, positive_only, exclude_same
        n, dims, ws = len(self.ids), np.asarray(dims), np.asarray(ws, float)
        rows = np.repeat(np.arange(n), sizes)
        self.norms = bucket_norms(rows, dims, ws, n)
        self.dims, cols = np.unique(dims, return_inverse=True)
        self.tile = _by_column(rows, cols, ws)
        self.kth = np.full(n, 0.0 if positive_only else -np.inf)
        self.row, self.vid, self.sim, self.skipped = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0), 0

    def known(self, qids, vids, sims) -> None:
        """Results of an earlier comparison."""
        self._keep(pd.Index(self.ids).get_indexer(np.asarray(qids)), np.asarray(vids), np.asarray(sims, float))

    def meet(self, ids, sizes, dims, ws, envelope) -> None:
        self.meet_block(IndexBlock(ids, sizes, dims, ws, envelope))

    def meet_block(self, index: IndexBlock) -> None:
        bound = self.norms @ index.envelope * (1 + 1e-9) + 1e-9
        if not (bound >= self.kth).any() or (self.positive_only and not len(self.dims)):
            self.skipped += 1
            return
        ids = index.ids
        sims = product(self.tile, index.tile_of(self.dims), (len(self.ids), len(ids)), len(self.dims))
        # Of positive similarities those count that nine decimals show.
        least = np.maximum(self.kth - 1e-9, 4e-10) if self.positive_only else self.kth - 1e-9
        near = sims >= least[:, None]
        if sims.shape[1] > self.k + 1:  # of many near ones in a row only its best k can stay, one of them may be itself
            full = np.flatnonzero(np.count_nonzero(near, axis=1) > 2 * (self.k + 1))
            place = sims.shape[1] - self.k - 1
            if len(full):
                least[full] = np.maximum(least[full], np.partition(sims[full], place, axis=1)[:, place] - 1e-9)
                near[full] = sims[full] >= least[full, None]
        r, c = np.divmod(np.flatnonzero(near), sims.shape[1])
        found, vids = np.round(sims[r, c], DECIMALS), ids[c]
        keep = found >= self.kth[r]
        if self.positive_only:
            keep &= found > 0
        if self.exclude_same:
            keep &= self.ids[r] != vids
        if keep.any():
            self._keep(r[keep], vids[keep], found[keep])

    def _keep(self, row: np.ndarray, vid: np.ndarray, sim: np.ndarray) -> None:
        row, sim = np.concatenate([self.row, row]), np.concatenate([self.sim, sim])
        vid = np.concatenate([self.vid, vid]) if len(self.vid) else vid
        code = pd.factorize(vid, sort=True)[0] if vid.dtype.kind not in "iu" else vid
        order = np.lexsort((code, -sim, row))
        row, vid, sim = row[order], vid[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k
        self.row, self.vid, self.sim = row[best], vid[best], sim[best]
        last = rank == self.k - 1
        self.kth[row[last]] = sim[last]


def _by_column(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(cols, kind="stable")
    return rows[order], cols[order], values[order]


def product(q_tile, v_tile, shape: tuple[int, int], n_dims: int) -> np.ndarray:
    """Dense product over dimensions common in both tiles, entry by entry over the rare ones."""
    q_count = np.bincount(q_tile[1], minlength=n_dims)
    v_count = np.bincount(v_tile[1], minlength=n_dims)
    common = q_count * v_count > shape[0] * shape[1] / 64
    hot = np.flatnonzero(common)
    slabs = [hot[start:start + SLAB] for start in range(0, len(hot), SLAB)]
    parts = (_dense(q_tile, slab, shape[0], n_dims) @ _dense(v_tile, slab, shape[1], n_dims).T for slab in slabs)
    sims = next(parts, None)
    sims = np.zeros(shape) if sims is None else sims
    for more in parts:
        sims += more
    rare = ~common[q_tile[1]] & (v_count[q_tile[1]] > 0)
    rows, cols, values = (part[rare] for part in q_tile)
    v_start = np.cumsum(v_count) - v_count
    matches = v_count[cols]
    flat = sims.ravel()
    for part in np.split(np.arange(len(rows)), _cuts(matches)) if len(rows) else ():
        n = matches[part]
        entry = np.repeat(part, n)
        other = np.repeat(v_start[cols[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = rows[entry] * shape[1] + v_tile[0][other]
        flat += np.bincount(cell, values[entry] * v_tile[2][other], minlength=flat.size)
    return sims


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """Where to split so that a part expands to about ``EXPANSION`` products."""
    return np.flatnonzero(np.diff(np.cumsum(sizes) // EXPANSION)) + 1


def _dense(tile, slab: np.ndarray, n: int, n_dims: int) -> np.ndarray:
    place = np.full(n_dims, -1)
    place[slab] = np.arange(len(slab))
    rows, cols, values = tile
    inside = place[cols] >= 0
    matrix = np.zeros((n, len(slab)))
    matrix[rows[inside], place[cols[inside]]] = values[inside]
    return matrix


def _envelopes(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers in order and their envelopes: MAX_BLOCKS small rows at most."""
    rows = blocks.select("block", "envelope").orderBy("block").collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]).reshape(len(rows), ENVELOPE)


def _pairs(blocks: DataFrame, numbers: np.ndarray, envelopes: np.ndarray, seeds: int) -> DataFrame:
    """``(qb, vb, bound)``: with a ``floor`` column the pairs after the seeds that reach it, else the seeds."""
    with_floor = "floor" in blocks.columns

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = np.stack(batch["envelope"]) @ envelopes.T * (1 + 1e-9) + 1e-9
            for k, qb in enumerate(batch["block"]):
                order = np.lexsort((numbers, -bounds[k]))
                if with_floor:
                    order = order[seeds:]
                    order = order[bounds[k][order] >= batch["floor"].iloc[k]]
                else:
                    order = order[:seeds]
                yield pd.DataFrame({"qb": qb, "vb": numbers[order], "bound": bounds[k][order]})

    return blocks.select("block", "envelope", *["floor"] * with_floor).mapInPandas(choose, "qb long, vb long, bound double")


def _compare(
    queries: DataFrame, index: DataFrame, pairs: DataFrame, tasks: int, k: int, positive_only: bool, exclude_same: bool, groups: DataFrame | None = None,
) -> DataFrame:
    """``(block, qid, vid, sim, floor)``: lists of the k best of each query of every block that has pairs.

    ``groups`` maps query blocks to groups ``(qb, part)``, each of which is compared in one task.
    """
    q_type, v_type = (t.schema["ids"].dataType.simpleString() for t in (queries, index))
    empty = {c: F.lit(None).cast(t) for c, t in (("qid", q_type), ("vid", v_type), ("sim", "array<double>"))}
    known = [F.col(c) if c in queries.columns else empty[c].alias(c) for c in empty]
    pairs = pairs.withColumn("part", F.col("qb")) if groups is None else pairs.join(F.broadcast(groups), "qb")  # MAX_BLOCKS rows at most
    asked = queries.join(pairs.select(F.col("qb").alias("block"), "part").distinct(), "block").select(
        "part", F.array("block").alias("qbs"), F.lit(float("-inf")).alias("turn"), F.col("ids").alias("q_ids"), F.lit(None).cast(v_type).alias("v_ids"),
        "sizes", "dims", "ws", F.lit(None).cast("array<double>").alias("envelope"), *known)
    wanted = pairs.groupBy("part", "vb").agg(F.collect_list("qb").alias("qbs"), F.max("bound").alias("bound"))
    sent = wanted.join(index, wanted["vb"] == index["block"]).select(
        "part", "qbs", (-F.col("bound")).alias("turn"), F.lit(None).cast(q_type).alias("q_ids"), F.col("ids").alias("v_ids"),
        "sizes", "dims", "ws", "envelope", *(c.alias(n) for n, c in empty.items()))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, schema = {}, None, None

        def done(number: int, block: QueryBlock) -> pa.RecordBatch:
            full = np.bincount(block.row, minlength=len(block.ids)) >= k
            floor = block.kth.min() if full.all() else (0.0 if positive_only else float("-inf"))
            return pa.RecordBatch.from_pydict(
                {"block": [number], "qid": [block.ids[block.row]], "vid": [block.vid], "sim": [block.sim], "floor": [floor]}, schema=schema)

        for batch in batches:
            types = (batch.schema.field(c).type for c in ("part", "q_ids", "v_ids", "envelope", "turn"))
            schema = pa.schema([*zip(("block", "qid", "vid", "sim", "floor"), types, strict=True)])
            column = {c: batch.column(c) for c in batch.schema.names}

            def values(name: str, at: int) -> np.ndarray:
                return column[name][at].values.to_numpy(zero_copy_only=False)

            for at, (group, blocks) in enumerate(zip(column["part"].to_pylist(), column["qbs"].to_pylist(), strict=True)):
                if group != part:
                    yield from (done(*held) for held in now.items())
                    now, part = {}, group
                if column["q_ids"][at].is_valid:
                    block = QueryBlock(*(values(c, at) for c in ("q_ids", "sizes", "dims", "ws")), k, positive_only, exclude_same)
                    if column["qid"][at].is_valid and len(column["qid"][at]):
                        block.known(*(values(c, at) for c in ("qid", "vid", "sim")))
                    now[blocks[0]] = block
                else:
                    met = IndexBlock(*(values(c, at) for c in ("v_ids", "sizes", "dims", "ws", "envelope")))
                    for number in blocks:
                        now[number].meet_block(met)
        yield from (done(*held) for held in now.items())

    # A group's query blocks are whole in one task, their index blocks after them, best bounds first.
    dealt = asked.unionByName(sent).repartition(tasks, "part").sortWithinPartitions("part", "turn")
    return dealt.mapInArrow(lists, f"block long, qid {q_type}, vid {v_type}, sim array<double>, floor double")


def _groups(queries: DataFrame) -> tuple[DataFrame, int]:
    """``(qb, part)`` of neighbouring query blocks, and the number of groups."""
    numbers = [r[0] for r in queries.select("block").orderBy("block").collect()]  # MAX_BLOCKS at most
    size = min(GROUP_BLOCKS, max(1, len(numbers) // GROUPS))
    rows = [(qb, i // size) for i, qb in enumerate(numbers)]
    return queries.sparkSession.createDataFrame(rows, "qb long, part long"), len({part for _, part in rows})


def search(
    queries: DataFrame, index: DataFrame, k: int, positive_only: bool = True, exclude_same: bool = True, seeds: int = SEEDS,
) -> DataFrame:
    """``(qid, vid, sim)`` of two tables of packed blocks; order is similarity at nine decimals, then id."""
    spark = queries.sparkSession
    numbers, envelopes = _envelopes(index)
    q_type, v_type = (t.schema["ids"].dataType.elementType.simpleString() for t in (queries, index))
    if not len(numbers):
        return spark.createDataFrame([], f"qid {q_type}, vid {v_type}, sim double")
    groups, made = _groups(queries)
    # Some more tasks than groups, so that few tasks get two.
    options = (min(MAX_TASKS, 4 * made + 1), k, positive_only, exclude_same, groups)
    first = _compare(queries, index, _pairs(queries, numbers, envelopes, seeds), *options)
    found = first
    if len(numbers) > seeds:
        path = scratch_path(spark, "seeded")
        first.write.parquet(path)
        first = spark.read.schema(first.schema).parquet(path)
        begun = queries.join(first, "block")
        path = scratch_path(spark, "pairs")
        _pairs(begun, numbers, envelopes, seeds).write.parquet(path)
        pairs = spark.read.schema("qb long, vb long, bound double").parquet(path)
        more = _compare(begun.drop("floor"), index, pairs, *options)
        settled = first.join(pairs.select(F.col("qb").alias("block")).distinct(), "block", "left_anti")
        found = settled.unionByName(more)
    return found.select(F.inline(F.arrays_zip("qid", "vid", "sim")))
