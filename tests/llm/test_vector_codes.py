"""Vector codes against k-means over every part and entry."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from shelfwise.llm.vector_codes import Assignment, Balls, anchors, metric_tree, part_codes, with_label_error

COLUMNS = "vec_id long, embedding array<double>, label int, vector string, code int, part int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(x * 4096) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = defaultdict(list)
            for x in cut:
                owned[nearest(x[p], books[p])[1]].append(x[p])
            for k, xs in owned.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    best = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    by_label = defaultdict(int)
    for (_, _, label), b in zip(kept, best):
        by_label[label] += sum(d for d, _ in b)
    return sorted(((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), by_label[label], sha) for (i, _, label), b in zip(kept, best)), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS).repartition(4)
    return sorted((tuple(r) for r in part_codes(df, **options).collect()), key=repr)


def clusters(seed, n, dims, centres=9, spread=0.01):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize("block", [50, 10_000])
def test_clusters(spark, block):
    """A third of all vectors alike and a hot label; blocks do not matter."""
    points = clusters(1, 400, 16, spread=0.1)
    points[::3] = points[0]
    rows = [(int(k), [*map(float, p)], int(k % 5) if k % 3 else None) for k, p in enumerate(points)]
    assert found(spark, rows, block=block) == brute(rows)


def test_odd_rows(spark):
    """Nulls in any column, vectors that are not numbers or too large or short, ties, repeated rows."""
    v = [[float((k * j) % 5) / 4 for j in range(8)] for k in range(12)]
    rows = [(k, x, k % 2) for k, x in enumerate(v)] + [
        (None, v[3], None), (20, v[3], None), (20, v[3], None), (20, v[4], 1), (21, None, 1), (22, [], 1), (23, [1.0] * 7 + [None], 1),
        (24, [math.nan] + [0.0] * 7, 1), (25, [math.inf] + [0.0] * 7, 0), (-5, [-0.1] * 8, 3), (26, [0.0] * 8, None)]
    assert found(spark, rows) == brute(rows)
    beyond = [(-9, [1e30] * 8, 1), (99, [0.5] * 16, 1), (-8, [0.5] * 9, 1)]
    assert found(spark, rows + beyond) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(3, [0.5] * 8, 1), (1, [0.25] * 8, None), (1, [0.25] * 8, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, 2)]) == []


def test_label_errors_without_broadcast(spark):
    coded = spark.createDataFrame([(k, k % 3 if k % 3 else None, k) for k in range(300)], "vec_id long, label int, error long").repartition(5)
    few, many = ({(r["vec_id"], r["label_error"]) for r in with_label_error(coded, n).collect()} for n in (10, 0))
    assert few == many and len(few) == 300


def test_anchors_are_nearest():
    """The comparisons that are left out change nothing: farthest first, nearest owner."""
    points = clusters(2, 500, 4)
    chosen, away = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < 20:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    owner, k = anchors(points, 20)
    assert k == 20 and (owner == np.linalg.norm(points[:, None] - points[chosen][None], axis=2).argmin(1)).all()


@pytest.mark.parametrize("seed", range(4))
def test_tree_covers_and_prunes(seed):
    """Balls hold their members; sums are exact; most distances of clustered points are never computed."""
    rows = np.floor(clusters(seed, 3000, 8) * 4096).astype(np.int64)
    rows[:50] = rows[0]
    tree = Balls.from_bytes(metric_tree(rows).to_bytes())
    assert (tree.points[tree.place] == rows).all()
    for ball in range(len(tree.count)):
        members = tree.points[slice(*tree.run[ball])]
        assert (np.sqrt(((members - tree.centre[ball]) ** 2).sum(1)) <= tree.radius[ball] * (1 + 1e-9)).all()
    entries = rows[np.random.default_rng(seed).integers(0, 3000, 16)]
    entries[7] = entries[3]
    done = Assignment(tree, entries)
    owner = ((rows[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (done.owner[tree.place] == owner).all()
    assert (done.count == np.bincount(owner, minlength=16)).all()
    assert all((done.total[k] == rows[owner == k].sum(0)).all() for k in range(16))
    assert done.compared < 0.35 * 16 * len(tree.points)


def test_points_on_a_plane_between_entries():
    """Ties everywhere: the lower entry owns them."""
    rows = np.array([[0, y] for y in range(-100, 100)], np.int64)
    done = Assignment(metric_tree(rows, 4), np.array([[5, 0], [-5, 0], [5, 0]]))
    assert (done.owner == 0).all() and done.count.tolist() == [200, 0, 0]
