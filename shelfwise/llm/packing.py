"""Bounded-space online best-fit packing of tokenised documents.

A document is its token ids and an end id; one longer than a sequence is cut into pieces
of the sequence's length, of which the first may be shorter. Pieces are dealt by a hash
into groups of about ``GROUP`` pieces, and each group is packed online by one task: a
piece goes into the open bin with the least free space that still holds it. Open bins are
kept by free space, with one bit per amount of free space that some bin has, so the best
bin is one bit operation away. At most ``OPEN_BINS`` bins are open; when one more is
needed, the fullest closes. A group's last bins are the only other waste.

Only lengths and numbers are shuffled, never texts.

Defined results: a null or empty text is its end id alone; equal documents and repeated rows
are packed each on their own; a very long text is cut like any other; an empty table gives no
piece; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

LENGTH = 1024
END_ID = 2
OPEN_BINS = 2048
#: Pieces packed by one task.
GROUP = 250_000
#: Chunks whose ids a worker remembers; beyond it the older half is forgotten.
MEMORY = 600_000
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's one added token. Where a text spells it out, the tokenizer file gives its id; so is it here.
ADDED = {"<|endoftext|>": 50256}

#: A single space between two other characters, where the vocabulary's pattern always starts a new piece.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_SPACE_AFTER_SPACE = re.compile(r"\s ")


class Encoder(dict):
    """Token ids, as little-endian bytes, of chunks that begin with a space; computed once per chunk.

    The vocabulary's pattern starts a new piece at a single space, so a text is the
    concatenation of its chunks.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMORY // 2:
            self.older = dict(self)
            self.clear()
        value = self.older.get(chunk)
        if value is None:
            value = self.whole(" " + chunk)
        self[chunk] = value
        return value

    def whole(self, text: str) -> bytes:
        encode = self.tokens.encode_ordinary
        if any(token in text for token in ADDED):
            encode = lambda t: self.tokens.encode(t, allowed_special="all")
        return np.array(encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        # Only white space before a space needs the slower way of cutting.
        first, *rest = _SPLIT.split(text) if _SPACE_AFTER_SPACE.search(text) else text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


@functools.cache
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for all tasks of a worker: what one has computed the next one remembers."""
    return Encoder(vocabulary)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length, but the first may be shorter."""
    first = (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(documents: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches):
        encoder = encoder_of(vocabulary)
        for batch in batches:
            doc_ids, numbers, starts, lengths, crcs = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    doc_ids.append(doc_id)
                    numbers.append(k)
                    starts.append(start)
                    lengths.append(n)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + n)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space; ``bits`` has a bit for each amount of free space that some bin has."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            if self.open == self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.length - free


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to every row with a ``doc_id``, ``piece`` and ``length``."""
    names = items.columns
    # The salt is stored with the pieces: it parts repeated rows, and a repeated task finds it as it was.
    salted = stored(items.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")), "pieces")
    groups = max(1, math.ceil(salted.count() / group))

    def best_fit(batches: Iterator[pa.RecordBatch]):
        current, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for number, size in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if number != current:
                    current, bins = number, Bins(length, open_bins)
                bin_id, at = bins.place(size)
                sequence.append((number << 40) + bin_id)
                offset.append(at)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    # The order is that of a hash: arrivals of mixed sizes, the same however often a task is repeated.
    order = F.xxhash64("doc_id", "piece", "_salt")
    dealt = salted.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_salt"), F.lit(groups)))
    return (
        dealt.repartition(groups, "_group").sortWithinPartitions("_group", order, "doc_id", "piece", "ids_crc32")
        .mapInArrow(best_fit, ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long")
    )


def packed(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise, cut and pack whole documents; ``vocabulary`` is the path of a byte-pair file on every executor."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return pack(pieces(documents, vocabulary, length), length, open_bins)
