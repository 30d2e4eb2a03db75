"""Codes of vectors by parts: k-means with metric trees built from anchors.

Each vector of whole numbers is cut into equal parts; the parts at one position share a
codebook. Vectors stay in blocks, as the input dealt them, and each block has one tree for
each position, built once and stored:

* *Anchors*: about sqrt(n) points are taken one by one, each the farthest member of the
  widest ball so far; it takes over members nearer to it. Members closer to their anchor
  than half the distance between two anchors are not compared at all.
* *Middle-out*: the anchors' balls are joined upwards, the pair with the smallest common
  ball first, and split downwards by anchors of their own until they are leaves.
* Every ball caches centre, radius, count and sum of its members.

A round walks the trees from the top, all balls of a level at once. A ball inherits the
entries that can still own one of its members, and drops those that another entry beats
everywhere in the ball. With one entry left the ball is owned whole: its cached sum and
count go to that entry, and nothing below is looked at. Only members of leaves that stay
contested are compared with the entries left over. Tasks send one sum a position and
entry, so a round shuffles and collects as many rows as there are entries, whatever the
table's size.

Everything that decides is whole numbers, or rounded floats with a margin on the safe
side; ties go to the lower entry. So the result does not depend on blocks or trees.

Defined results: rows whose vector is null or empty, or holds a null, NaN, infinity or a
number beyond ``LIMIT`` in size (sums of squares would leave 64 bits) are dropped, and so is a vector
that is not as long as that of the first row (by vec_id, then vector) whose length the parts divide; null vec_ids come
last; repeated rows are rows of their own, also in the first codebooks; with fewer rows
than entries there are as many entries as rows; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Vectors in a block at most; members of a leaf; numbers of this size and more are dropped.
BLOCK, LEAF, LIMIT = 8_192, 24, 1 << 14
#: Relative margin for rounded distances, far above what rounding does to numbers below LIMIT * SCALE.
MARGIN = 1e-6
#: Labels up to which their errors are broadcast; more are joined in SALTS copies.
BROADCAST_LABELS, SALTS = 100_000, 16


def _lengths(points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", points, points))


def anchors(points: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(owner of each point, number of anchors): each point belongs to its nearest anchor."""
    chosen = [0]
    far, owner = _lengths(points - points[0]), np.zeros(len(points), np.int64)
    while len(chosen) < k:
        new = int(far.argmax())  # the farthest member of the widest ball
        if far[new] == 0:
            break
        between = _lengths(points[chosen] - points[new])
        near = np.flatnonzero(far > between[owner] / 2)  # the others cannot be nearer to the new one
        away = _lengths(points[near] - points[new])
        closer = away < far[near]
        owner[near[closer]], far[near[closer]] = len(chosen), away[closer]
        chosen.append(new)
    return owner, len(chosen)


def _grown(members: np.ndarray, points: np.ndarray, leaf: int) -> tuple:
    """(members, children) of a ball; a leaf has no children."""
    if len(members) <= leaf:
        return members, ()
    owner, k = anchors(points[members], max(2, round(len(members) ** 0.5)))
    return _joined([_grown(members[owner == a], points, leaf) for a in range(k)], points)


def _joined(balls: list[tuple], points: np.ndarray) -> tuple:
    """One ball over all: the two with the smallest common ball are joined first."""
    centre = np.array([points[members].mean(0) for members, _ in balls])
    radius = np.array([_lengths(points[members] - c).max() for (members, _), c in zip(balls, centre, strict=True)])
    gone = np.zeros(len(balls))

    def common(a: int) -> np.ndarray:
        """Size of the smallest ball around ball a and each other."""
        out = (_lengths(centre - centre[a]) + radius + radius[a]) / 2 + gone
        out[a] = np.inf
        return out

    sizes, a = np.array([common(a) for a in range(len(balls))]), 0
    for _ in range(len(balls) - 1):
        a, b = sorted(divmod(int(sizes.argmin()), len(balls)))
        n, m = len(balls[a][0]), len(balls[b][0])
        balls[a] = (np.concatenate([balls[a][0], balls[b][0]]), (balls[a], balls[b]))
        centre[a] = (centre[a] * n + centre[b] * m) / (n + m)
        radius[a], gone[b] = _lengths(points[balls[a][0]] - centre[a]).max(), np.inf
        sizes[b] = sizes[:, b] = np.inf
        sizes[a] = sizes[:, a] = common(a)
    return balls[a]


@dataclass
class Balls:
    """The balls of a tree; ball 0 holds all, and a ball's members are a run of ``points``."""

    centre: np.ndarray
    radius: np.ndarray
    count: np.ndarray  # rows in the ball
    total: np.ndarray  # and their sum
    children: np.ndarray  # two balls, or -1 for a leaf
    run: np.ndarray  # start and end in points
    points: np.ndarray  # distinct rows
    place: np.ndarray  # row -> its point

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Balls:
        return Balls(**np.load(io.BytesIO(data)))


def metric_tree(rows: np.ndarray, leaf: int = LEAF) -> Balls:
    """The anchors hierarchy over the distinct rows; equal rows count as one point."""
    points, place, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    stack, children, run, held, order = [(_grown(np.arange(len(points)), points.astype(float), leaf), None, 0)], [], [], [], []
    done = 0
    while stack:  # a ball, then all below it: its members follow one another
        (members, below), parent, side = stack.pop()
        if parent is not None:
            children[parent][side] = len(children)
        run.append((done, done + len(members)))
        held.append(members)
        if not below:
            order.append(members)
            done += len(members)
        stack += ((ball, len(children), s) for s, ball in reversed([*enumerate(below)]))
        children.append([-1, -1])
    order = np.concatenate(order)
    count = np.array([weight[m].sum() for m in held])
    total = np.array([(points[m] * weight[m, None]).sum(0) for m in held])
    centre = total / count[:, None]
    radius = np.array([_lengths(points[m] - c).max() for m, c in zip(held, centre, strict=True)])
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    return Balls(centre, radius, count, total, np.array(children), np.array(run), points[order], where[place.ravel()])


class Assignment:
    """What each entry owns of a tree; ``compared`` counts distances to points."""

    def __init__(self, balls: Balls, entries: np.ndarray):
        self.balls, self.entries, self.compared = balls, entries, 0
        self.owner = np.zeros(len(balls.points), np.int64)
        self.total, self.count = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        self.weight = np.bincount(balls.place, minlength=len(balls.points))
        self._descend()

    def _descend(self) -> None:
        balls, entries = self.balls, self.entries.astype(float)
        between = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2))
        first = np.array([not (between[:k, k] == 0).any() for k in range(len(entries))])  # of equal entries the lowest owns
        level, able = np.zeros(1, np.int64), first[None]
        while len(level):
            away = ((balls.centre[level][:, None] - entries[None]) ** 2).sum(2)
            away[~able] = np.inf
            best = away.argmin(1)
            least = away[np.arange(len(level)), best][:, None]
            # Beaten everywhere: the ball lies on the best entry's side of the plane between the two.
            with np.errstate(invalid="ignore"):
                beaten = away - least > 2 * balls.radius[level][:, None] * between[best] + MARGIN * (away + least + 1)
            able = able & ~(beaten | np.isinf(away))
            whole = able.sum(1) == 1
            self._own(level[whole], able[whole].argmax(1))
            leaf = balls.children[level, 0] < 0
            self._compare(level[leaf & ~whole], able[leaf & ~whole])
            open_balls = ~leaf & ~whole
            level, able = balls.children[level[open_balls]].ravel(), np.repeat(able[open_balls], 2, 0)

    def _own(self, level: np.ndarray, entry: np.ndarray) -> None:
        np.add.at(self.total, entry, self.balls.total[level])
        np.add.at(self.count, entry, self.balls.count[level])
        for (start, end), e in zip(self.balls.run[level], entry, strict=True):
            self.owner[start:end] = e

    def _compare(self, level: np.ndarray, able: np.ndarray) -> None:
        if not len(level):
            return
        sizes = np.diff(self.balls.run[level]).ravel()
        members = np.concatenate([np.arange(start, end) for start, end in self.balls.run[level]])
        able, points = np.repeat(able, sizes, 0), self.balls.points[members]
        away = np.full(able.shape, np.iinfo(np.int64).max)
        for k, entry in enumerate(self.entries):
            asked = able[:, k]
            away[asked, k] = ((points[asked] - entry) ** 2).sum(1)
        self.compared += int(able.sum())
        self.owner[members] = owner = away.argmin(1)  # the lowest of equals
        weight = self.weight[members]
        np.add.at(self.total, owner, points * weight[:, None])
        np.add.at(self.count, owner, weight)

    def errors(self) -> np.ndarray:
        """Squared distance of every point to its entry."""
        return ((self.balls.points - self.entries[self.owner]) ** 2).sum(1)


def _blocks(parts: int, size: int):
    """Rows to blocks: their ids and labels beside a tree for each part."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
            trees = [metric_tree(part).to_bytes() for part in np.split(vectors, parts, 1)]
            lists = [pa.ListArray.from_arrays([0, len(rows)], rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], ["vec_ids", "labels", "trees"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), size):
                held.append(batch.slice(start, size))
                if sum(map(len, held)) >= size:
                    rows = pa.Table.from_batches(held)
                    yield block(rows.slice(0, size))
                    held = rows.slice(size).to_batches()
        if sum(map(len, held)):
            yield block(pa.Table.from_batches(held))
    return write


def _sums(codebooks: list[np.ndarray]):
    """Sum and count of what each entry owns, once for all blocks of a task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros_like(c) for c in codebooks], [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for trees in batch.column("trees").to_pylist():
                for part, (data, codebook) in enumerate(zip(trees, codebooks, strict=True)):
                    found = Assignment(Balls.from_bytes(data), codebook)
                    totals[part] += found.total
                    counts[part] += found.count
        for part, (total, count) in enumerate(zip(totals, counts, strict=True)):
            entry, position = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, part, np.int32)), pa.array(entry, pa.int32()), pa.array(position, pa.int32()),
                 pa.array(total.ravel()), pa.array(np.repeat(count, total.shape[1]))], ["part", "entry", "position", "total", "n"])
    return add


def _codes(codebooks: list[np.ndarray]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, trees in enumerate(batch.column("trees").to_pylist()):
                found = [Assignment(Balls.from_bytes(data), codebook) for data, codebook in zip(trees, codebooks, strict=True)]
                owners = np.stack([f.owner[f.balls.place] for f in found], 1).astype(np.uint8)
                error = sum(f.errors()[f.balls.place] for f in found)
                ids, labels = batch.column("vec_ids")[k].values, batch.column("labels")[k].values
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([row.tobytes().hex() for row in owners]), pa.array(error)], ["vec_id", "label", "code", "error"])
    return write


def whole_vectors(embeddings: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and the vector in whole numbers of every row that is kept."""
    vector = F.col("embedding")
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LIMIT))
    rows = embeddings.where(F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label",
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vector"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector")).first()
    return rows.where(F.size("vector") == (first[0] if first else 0))


def part_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row. At most 256 entries."""
    rows = whole_vectors(embeddings, parts)
    first = [r["vector"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    codebooks = np.split(np.array(first, np.int64), parts, 1) if first else []
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    blocks = stored(
        rows.mapInArrow(_blocks(parts, block), f"vec_ids array<{id_type}>, labels array<{label_type}>, trees array<binary>"), "code-blocks")
    for _ in range(rounds if first else 0):
        found = blocks.select("trees").mapInArrow(_sums(codebooks), "part int, entry int, position int, total long, n long")
        # One row for each number of the codebooks.
        for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            if r["n"]:
                codebooks[r["part"]][r["entry"], r["position"]] = r["total"] // r["n"]
    sha = hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()
    coded = stored(blocks.mapInArrow(_codes(codebooks), f"vec_id {id_type}, label {label_type}, code string, error long"), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def with_label_error(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS, salts: int = SALTS) -> DataFrame:
    """Add the error summed over equal labels, nulls together; null where a sum leaves 64 bits."""
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= broadcast_labels:
        return coded.join(F.broadcast(sums), same)
    # A hot label's rows are dealt over the copies of its sum.
    sums = sums.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(sums, same & (F.col("salt") == F.col("copy")))
