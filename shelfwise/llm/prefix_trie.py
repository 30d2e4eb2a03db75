"""Prefix trie of conversations by ternary search trees, one for each range of sequences.

Turns are replaced by ids of a dictionary of (role, text), so that texts are read once and
never shuffled. Conversations become sequences of ids; equal sequences are one row with a
count. The distinct sequences are cut into ranges of about ``SHARD``; a task holds the tree
of one range at a time, balanced by inserting medians first, and walks it with a stack of
its own to add up members, leaves and savings.

Sorted ranges share only nodes on their edges: prefixes that a range's first sequence has
in common with the last one before it. Each range knows these two lengths, counts what a
shared node owns only in the first range that has it, and so its partial rows merge by
plain sums. All other nodes are whole where they were made.

The digest of the ids that end at a node is fed with sorted runs of ids that other tasks have
already joined to text, so a sequence held by a third of all conversations is never a list.

Defined results: rows without conv_id belong to no conversation; null role and text are
empty; turns with equal numbers are ordered by the SHA-256 of ``<length of role>:<role><text>``;
repeated rows are turns of their own; a null turn number comes first; a conversation is held
as one array of ids, 16 bytes a turn, however long its texts; an empty table gives no nodes, not
even a root; other columns are ignored, whatever their names. Turns are told apart by their
SHA-256.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import sha256_hex, stored
from shelfwise.operators.ids import ordinal_ids

#: Every so many conversations share the first turns of one of them, and at most how many less one.
EVERY, HEADS = 20, 4
#: Sequences to a range, about; ids to a run of those that end at a node.
SHARD, RUN = 20_000, 4_096
#: Shared nodes up to which their names are broadcast; more are joined.
BROADCAST_NODES = 100_000
ROW = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
WORDS = r"[^\x20\x09-\x0D]+"


class TernaryTree:
    """Sequences of ids. A node holds an id; smaller and greater ids of the same place hang beside it, the next place below."""

    def __init__(self) -> None:
        self.turn, self.less, self.more, self.below = [-1], [0], [0], [0]  # node 0 stands for the root

    def path(self, sequence: list[int], add: bool = False) -> list[int]:
        """Nodes of a sequence in order; ``add`` makes the missing ones."""
        turn, less, more, below = self.turn, self.less, self.more, self.below
        nodes, at = [], 0
        for number in sequence:
            links, came = below, at
            at = below[at]
            while at and turn[at] != number:
                links, came = (less, at) if number < turn[at] else (more, at)
                at = links[at]
            if not at:
                if not add:
                    raise KeyError(sequence)
                at = links[came] = len(turn)
                turn.append(number)
                for each in (less, more, below):
                    each.append(0)
            nodes.append(at)
        return nodes

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent, depth), parents before children, from a stack."""
        stack = [(self.below[0], 0, 1)]
        while stack:
            node, parent, depth = stack.pop()
            if node:
                yield node, parent, depth
                stack += ((self.less[node], parent, depth), (self.more[node], parent, depth), (self.below[node], node, depth + 1))


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the median of each range before those of its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += ((low, middle), (middle + 1, high))


def chained(sequence: list[int]) -> Iterator[bytes]:
    """A name for each prefix of a sequence, the empty one included."""
    name = b"root"
    yield name
    for number in sequence:
        name = hashlib.blake2b(name + number.to_bytes(8, "little"), digest_size=16).digest()
        yield name


def shard_nodes(sequences: list[list[int]], words: list[list[int]], counts: list[int], firsts: list[int], ends: list[str], before: int, after: int) -> list[tuple]:
    """Rows of the trie of sorted, distinct sequences: (key, parent_key, *ROW).

    ``before`` and ``after``: turns that the first and last sequence share with the
    neighbouring ranges, -1 without one. Only shared nodes have a key; a node whose parent
    is shared has the parent's key in place of its conv_id.
    """
    tree, last_word, ended = TernaryTree(), {0: 0}, {}
    for k in medians(len(sequences)):
        path = [0, *tree.path(sequences[k], add=True)]
        last_word.update(zip(path[1:], words[k], strict=True))
        ended[path[-1]] = k
    known, shared = set(), {}
    for k, depth in ((0, before), (-1, after)):
        path = [0, *tree.path(sequences[k])]
        shared.update(zip(path[: depth + 1], chained(sequences[k])))
        if k == 0:
            known.update(path[: depth + 1])  # counted by an earlier range
    followed = set([0, *tree.path(sequences[-1])][: after + 1])  # has children or members in the next range
    order = [(0, -1, 0), *tree.walk()]
    size = len(tree.turn)
    members, smallest, children, leaves, saved = [0] * size, [math.inf] * size, [0] * size, [0] * size, [0] * size
    for node, k in ended.items():
        members[node], smallest[node] = counts[k], firsts[k]
    for node, parent, _ in reversed(order):
        if not tree.below[node] and node not in followed:
            leaves[node] = 1
        saved[node] += (members[node] - (node not in known)) * last_word[node]
        if node:
            members[parent] += members[node]
            smallest[parent] = min(smallest[parent], smallest[node])
            children[parent] += node not in known
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    return [
        (shared.get(node), shared.get(parent), smallest[node], depth, None if parent < 0 or parent in shared else smallest[parent],
         members[node], children[node], leaves[node], saved[node], ends[ended[node]] if node in ended else None)
        for node, parent, depth in order
    ]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) to (seq, first, n, ids), at most RUN ids a row."""
    seq, run = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"seq": [seq], "first": [run[0]], "n": [len(run)], "ids": [",".join(map(str, run))]})

    for batch in batches:
        out = []
        for key, conv_id in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if run and (key != seq or len(run) == RUN):
                out.append(row())
                run = []
            seq = key
            run.append(conv_id)
        yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
    if run:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (seq, first) to (conv_id, n, ends_sha256) of each seq; holds one digest at a time."""
    seq, first, n, digest = None, None, 0, None
    for batch in batches:
        out = []
        for key, at, size, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "n", "ids")), strict=True):
            if key != seq:
                if digest:
                    out.append((first, n, digest.hexdigest()))
                seq, first, n, digest = key, at, 0, hashlib.sha256()
            digest.update(("," * bool(n) + ids).encode())
            n += size
        if out:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*out, strict=True))], ["conv_id", "n", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_pydict({"conv_id": [first], "n": [n], "ends_sha256": [digest.hexdigest()]})


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, ids) to nodes, one range at a time."""
    schema = pa.schema([
        ("key", pa.binary()), ("parent_key", pa.binary()), *((c, pa.int64()) for c in (
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])
    names = ("ids", "words", "n", "conv_id", "ends_sha256")
    now, edges, held = None, (-1, -1), [[] for _ in names]

    def nodes() -> Iterator[pa.RecordBatch]:
        if held[0]:
            columns = zip(*shard_nodes(*held, *edges), strict=True)
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches(10_000)

    for batch in batches:
        rows = batch.to_pydict()
        for k, shard in enumerate(rows["shard"]):
            if shard != now:
                yield from nodes()
                now, edges, held = shard, (rows["before"][k], rows["after"][k]), [[] for _ in names]
            for values, name in zip(held, names, strict=True):
                values.append(rows[name][k])
    yield from nodes()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id with the dictionary ids and word counts of its turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = stored(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn",
            F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
            F.regexp_count(text, F.lit(WORDS)).alias("words")), "trie-turns")
    dictionary = ordinal_ids(turns.groupBy("digest").agg(F.first("words").alias("words")), ["digest"], "turn_id")
    turn = F.struct("turn", "digest", "turn_id", "words")  # null turns sort first
    held = turns.drop("words").join(dictionary, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return held.select("conv_id", F.col("turns.turn_id").alias("ids"), F.col("turns.words").alias("words"))


def rebuilt(held: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Each conversation with its first turns taken from the first of its ``every``, by the hash of its id."""
    held = stored(held, "trie-sequences")
    head = held.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), *(F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "words")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = held.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(head, "base", "left")

    def both(column: str) -> Column:
        taken = F.slice(F.coalesce(f"head_{column}", F.slice(column, 1, 0)), F.lit(1), F.col("h"))
        return F.concat(taken, F.slice(column, F.col("h") + 1, F.size(column)))

    return joined.select("conv_id", both("ids").alias("ids"), both("words").alias("words"))


def prefix_trie(held: DataFrame, shard: int = SHARD) -> DataFrame:
    """Every node of the trie over the sequences ``ids`` of ``held`` (conv_id, ids, words)."""
    seq = F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))
    held = stored(held.withColumn("seq", seq), "trie-rebuilt")
    spark = held.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = held.select("seq", "conv_id").repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _runs, "seq binary, first long, n long, ids string")
    distinct = runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "conv_id long, n long, ends_sha256 string")
    distinct = stored(distinct, "trie-distinct")
    shards = max(1, math.ceil(distinct.count() / shard))
    ranges = stored(
        held.drop("seq").join(distinct, "conv_id").repartitionByRange(shards, "ids").sortWithinPartitions("ids")
        .withColumn("shard", F.spark_partition_id()), "trie-ranges")
    # A row for each range; arrays compare like sequences.
    edge = ranges.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    in_order = Window.orderBy("shard")

    def common(left: Column, right: Column) -> Column:
        differ = F.array_position(F.zip_with(left, right, lambda a, b: a.eqNullSafe(b)), False) - 1
        return F.coalesce(differ, F.lit(-1))  # distinct sequences differ somewhere

    edges = edge.select(
        "shard", common(F.lag("high").over(in_order), F.col("low")).alias("before"), common(F.col("high"), F.lead("low").over(in_order)).alias("after"))
    nodes = stored(
        ranges.join(edges, "shard").repartition("shard").sortWithinPartitions("shard", "ids")
        .mapInArrow(_trees, f"key binary, parent_key binary, {ROW}"), "trie-nodes")
    return _merged(nodes)


def _merged(nodes: DataFrame) -> DataFrame:
    """Sum what the ranges know of shared nodes, and name shared parents."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    edge = stored(
        nodes.where("key IS NOT NULL").groupBy("key").agg(
            F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
            F.first("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in sums), F.max("ends_sha256").alias("ends_sha256")),
        "trie-edge")
    names = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("shared_parent"))
    names = F.broadcast(names) if edge.count() <= BROADCAST_NODES else names
    whole = nodes.where("key IS NULL").unionByName(edge)
    below = whole.where("parent_key IS NOT NULL").join(names, "parent_key").withColumn("parent_conv_id", F.col("shared_parent"))
    columns = [c.split()[0] for c in ROW.split(", ")]
    every = whole.where("parent_key IS NULL").select(*columns).unionByName(below.select(*columns))
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256_hex(""))))


def conversation_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(sequences(conversations)), shard)
