"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every document's words.

Words are runs of digits, lower-cased ASCII letters and bytes of other scripts. Each
benchmark item gives its windows of ``WINDOW`` words (an item of fewer words is one
window). A document position can start a window only if the next words all occur in the
benchmark, so most positions fall out by a vectorised test; the rest are looked up in the
hash set, whose keys are the words themselves: a hit is verified by comparing them.

The set is broadcast in blocks of at most ``MAX_WINDOWS`` windows. A benchmark of more
windows is scanned block by block over a stored table that carries the hits so far.

Defined results: a null or empty text has no words and no hits; an item without words has
no window; a null item id is not reported; repeated items count once; repeated documents
are judged row by row; an empty benchmark contaminates nothing; the input row is carried in
``row``, so other columns may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import sha256_hex, stored

WINDOW = 13
#: Windows in one broadcast block: some 40 MB.
MAX_WINDOWS = 200_000
#: A document is contaminated when at least one word in this many is hit.
ONE_IN = 20

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WindowSet:
    """Windows of benchmark items by length, and the vocabulary that occurs in them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items: dict[int, dict[bytes, list[str]]] = {}
        self.vocabulary: set[bytes] = set()
        for item, text in items:
            found = words(text)
            n = min(window, len(found))
            if not n:
                continue
            self.vocabulary.update(found)
            by_window = self.items.setdefault(n, {})
            for i in range(len(found) - n + 1):
                owners = by_window.setdefault(b" ".join(found[i : i + n]), [])
                if item not in owners:
                    owners.append(item)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open word ranges that a window covers, and the items hit."""
        spans, hit = [], set()
        if not found:
            return spans, hit
        known = np.fromiter(map(self.vocabulary.__contains__, found), bool, len(found))
        run = np.concatenate(([0], np.cumsum(known)))
        for n, by_window in self.items.items():
            if len(found) < n:
                continue
            for i in np.flatnonzero(run[n:] - run[:-n] == n).tolist():
                owners = by_window.get(b" ".join(found[i : i + n]))
                if owners:
                    spans.append((i, i + n))
                    hit.update(owners)
        return spans, hit


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _scanned(rows: DataFrame, block, first: bool) -> DataFrame:
    """Add the hits of one block to every row; texts stay binary."""
    kept = ["text", "row"]

    def scan(batches):
        windows = block.value
        for batch in batches:
            n_words, spans, items = [], [], []
            before = [batch.column(c).to_pylist() for c in ("spans", "items")] if not first else [[[]] * batch.num_rows] * 2
            for text, old_spans, old_items in zip(batch.column("text").to_pylist(), *before, strict=True):
                found = words(text)
                new, hit = windows.scan(found)
                n_words.append(len(found))
                spans.append([list(s) for s in merged([*map(tuple, old_spans), *new])])
                items.append(sorted(hit.union(old_items)))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                 pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "spans", "items"])

    return rows.mapInArrow(scan, T.StructType([*rows.select(kept).schema, *_HITS]))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans (word ranges), contaminated, row."""
    spark = documents.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / max_windows))
    rows = documents.select(
        F.col("text").cast("string").cast("binary").alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("row"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"].encode()) for r in part.collect()], window))
        rows = _scanned(rows, block, k == 0)
        if k + 1 < blocks:
            rows = stored(rows, "contamination")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        "items", "spans",
        F.struct(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns)).alias("row"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


EMPTY_DIGEST = sha256_hex("")
