"""SimHash near-duplicates with a Gray-ordered hierarchical index.

Fingerprints: the majority of each bit over the hashes of all word shingles. Documents
whose fingerprints differ in at most ``DISTANCE`` bits are linked, and a component is
everything reachable over links.

Only distinct fingerprints are searched. The top nodes of the index are masks: the 64 bits
are cut into segments, and two fingerprints within the distance agree on all bits of at
least one choice of ``len(segments) - DISTANCE`` segments. Each choice is a mask, and the
fingerprints that share the masked bits form one node. There are as many segments as keep
such nodes small for the number of fingerprints; no number loses a link.

Inside a node the fingerprints are sorted by Gray rank, so that neighbours differ in few
bits, and runs of ``FANOUT`` form lower nodes: the bits all members share (a mask and their
pattern) move up into the node. A search adds up the differences from a node's pattern and
drops the whole group as soon as they exceed the distance. A node with more than ``BLOCK``
fingerprints is dealt over tasks in blocks, each pair of blocks once, so nothing is capped.
Of each group a task emits one edge per linked fingerprint, to the smallest it reaches there.

Components are found by alternating large-star and small-star steps over stored edge
tables; nothing is collected.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
fewer words than a shingle are hashed as they are; repeated rows keep their rows and share
the component; null doc_ids never name a component unless all of it is null; an empty table
gives an empty result; the columns other than doc_id and text are not used.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
FANOUT = 16
BLOCK = 4096
#: Fingerprints that a top node should hold on average, at most.
NODE = 256
#: Search rows expanded at once.
SLICE = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit majority over the shingles' hashes; zero without words."""
    words = (text or b"").lower().split()  # of bytes: only ASCII letters and white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    runs = zip(*(words[k:] for k in range(shingle)), strict=False)
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, keep_row: bool = False) -> DataFrame:
    """doc_id, the fingerprint ``fp`` as a signed long, and the input row if asked for."""
    kept = ["doc_id", *(["row"] if keep_row else [])]
    whole = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if keep_row else []
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *whole)

    def compute(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found.view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(compute, T.StructType([*rows.select(kept).schema, T.StructField("fp", T.LongType())]))


def masks(n: int, distance: int = DISTANCE, node: int = NODE) -> list[int]:
    """Masks of which any two fingerprints within the distance agree on one; more and longer masks for more rows."""
    for segments in range(distance + 1, 2 * distance + 2):
        kept = segments - distance
        edges = [64 * k // segments for k in range(segments + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        found = [sum(c) for c in combinations(parts, kept)]
        if n <= node << min(m.bit_count() for m in found):
            break
    return found


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place in the Gray sequence: each bit is the parity of all bits from the top down to it."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over groups of fingerprints that are sorted by group and Gray rank."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        level_group = np.arange(len(starts))[np.cumsum(np.append(True, group[1:] != group[:-1])) - 1]
        self.pattern, self.mask = [fp], [np.full(len(fp), ~np.uint64(0))]
        self.first, self.size = [np.arange(len(fp))], [np.ones(len(fp), int)]
        self.top_group = level_group
        while len(self.top_group) > len(starts):
            owner = self.top_group
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
            first = np.flatnonzero(within % fanout == 0)
            shared_ones = np.bitwise_and.reduceat(self.pattern[-1] & self.mask[-1], first)
            shared_zeros = np.bitwise_and.reduceat(~self.pattern[-1] & self.mask[-1], first)
            self.mask.append(shared_ones | shared_zeros)
            self.pattern.append(shared_ones)
            self.first.append(first)
            self.size.append(np.diff(np.append(first, len(owner))))
            self.top_group = owner[first]
        self.group = level_group

    def links(self, fp: np.ndarray, distance: int):
        """Pairs of rows (smaller first) in one group within the distance, slice by slice."""
        for at in range(0, len(fp), SLICE):
            rows = np.arange(at, min(at + SLICE, len(fp)))
            query, node = rows, self.group[rows]  # one top node per group
            for level in range(len(self.pattern) - 1, 0, -1):
                differ = np.bitwise_count((fp[query] ^ self.pattern[level][node]) & self.mask[level][node])
                query, node = query[differ <= distance], node[differ <= distance]
                size = self.size[level][node]
                child = np.repeat(self.first[level][node] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                query, node = np.repeat(query, size), child
            near = (node > query) & (np.bitwise_count(fp[query] ^ fp[node]) <= distance)
            yield query[near], node[near]


def _smallest_reached(fp: np.ndarray, group: np.ndarray, distance: int) -> np.ndarray:
    """Row number of the smallest row that each row reaches over links within its group."""
    label = np.arange(len(fp))
    pairs = [np.concatenate(x) for x in zip(*GrayIndex(fp, group).links(fp, distance), strict=True)]
    while len(pairs[0]):
        a, b = label[pairs[0]], label[pairs[1]]
        if (a == b).all():
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def near_edges(classes: DataFrame, distance: int = DISTANCE, node: int = NODE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v), u > v, over distinct fingerprints ``fp`` whose components are those of all links."""
    chosen = masks(classes.count(), distance, node)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    tops = classes.select("fp", F.posexplode(F.array(*(F.lit(m) for m in signed))).alias("mask", "bits")).select(
        "fp", F.col("mask").cast("int").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("top"))
    large = stored(
        tops.groupBy("mask", "top").count().where(F.col("count") > block)
        .select("mask", "top", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-nodes")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        tops.join(large, ["mask", "top"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("mask", "top", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )

    def link(batches):
        held = None

        def edges(table: pa.Table) -> pa.RecordBatch:
            fp = table.column("fp").to_numpy().view(np.uint64)
            keys = [table.column(c).to_numpy() for c in ("mask", "top", "low", "high")]
            order = np.lexsort([gray_rank(fp), *keys[::-1]])
            fp, keys = fp[order], [k[order] for k in keys]
            group = np.cumsum(np.any([np.append(True, k[1:] != k[:-1]) for k in keys], axis=0))
            label = _smallest_reached(fp, group, distance)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            u, v = fp[linked].view(np.int64), fp[label[linked]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [table.column(c).to_numpy() for c in ("mask", "top", "low", "high")]
            last = np.all([k == k[-1] for k in keys], axis=0)
            at = int(np.argmax(last))  # rows are sorted: the last group may go on in the next batch
            if at:
                yield edges(table.slice(0, at))
            held = table.slice(at).combine_chunks()
        if held is not None:
            yield edges(held)

    keys = ["mask", "top", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link, "u long, v long").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(u, v) with v the smallest node that u reaches, for every u that is not itself the smallest."""
    edges, before = stored(edges, name), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), name)
        low = stored(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("low")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        large = stored(large.distinct(), name)
        low = stored(large.groupBy("u").agg(F.min("v").alias("low")), name)
        small = large.join(low, "u")
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(small.select("u", F.col("low").alias("v"))).where("u != v").distinct(), name)


def _named(prints: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Of stored fingerprints with row numbers: (fp, root) of every class, and the first row of every root."""
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "number")
    classes = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(near_edges(classes.select("fp"), distance))
    rooted = stored(
        classes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp")), "rooted")
    return rooted.select("fp", "root"), stored(rooted.groupBy("root").agg(F.min("first").alias("first")), "components")


def _printed(documents: DataFrame, shingle: int, keep_row: bool) -> DataFrame:
    return stored(fingerprints(documents, shingle, keep_row).withColumn("number", F.monotonically_increasing_id()), "fingerprints")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the component)."""
    prints = _printed(documents, shingle, False)
    rooted, first = _named(prints, distance)
    named = stored(rooted.join(first, "root").select("fp", F.col("first.doc_id").alias("component_id")), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The row of the smallest doc_id of every component, with all its columns."""
    prints = _printed(documents, shingle, True)
    _, first = _named(prints.drop("row"), distance)
    return prints.join(first.select(F.col("first.number").alias("number")), "number", "left_semi").select("row.*")
