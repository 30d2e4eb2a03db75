import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import blocks as B
from shelfwise.operators import short_lists
from shelfwise.operators import similarity as S


def brute_force(matrix, k, queries=None):
    """Best k by cosine at nine decimals, id ascending on ties, positive only, self excluded."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    sims = np.round(unit @ unit.T, 9)
    out = {}
    for i in range(len(matrix)) if queries is None else queries:
        order = sorted((j for j in range(len(matrix)) if j != i and sims[i, j] > 0), key=lambda j: (-sims[i, j], j))
        for j in order[:k]:
            out[(i, j)] = sims[i, j]
    return out


def long_form(spark, matrix):
    cells = [(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(cells, "id long, dim long, x double").repartition(4)


def skewed(seed, n=90, dims=60):
    """A third of the rows are copies of one vector, and one dimension is in most rows."""
    rng = np.random.default_rng(seed)
    matrix = np.where(rng.random((n, dims)) < 0.06, rng.integers(1, 6, (n, dims)), 0).astype(float)
    matrix[:, 0] = np.where(rng.random(n) < 0.7, 2.0, 0.0)
    matrix[: n // 3] = matrix[0] + (matrix[0].sum() == 0)
    return matrix


def search(spark, matrix, k, **options):
    vectors = S.cut_lineage(S.unit_vectors(long_form(spark, matrix), "id", "dim", "x"))
    return {(r.qid, r.vid): r.sim for r in S.top_k(vectors, vectors, k, **options).collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [
    {},                                              # blocks, the cheaper way here
    {"cells_per_pair": 0},                           # joins only: every list is short enough
    {"cells_per_pair": 0, "short_list": 8},          # mixed: hot dimensions bounded, open queries in blocks
    {"cells_per_pair": 0, "short_list": 1},
    {"cells_per_pair": 0, "short_list": 0},          # every dimension is hot
])
def test_every_way_gives_the_exact_neighbours(spark, seed, options):
    matrix = skewed(seed)
    got = search(spark, matrix, 5, **options)
    assert got == pytest.approx(brute_force(matrix, 5), abs=2e-9)


@pytest.mark.parametrize("options", [
    {"ids": 7}, {"entries": 40}, {"ids": 5, "seeds": 1}, {"ids": 3, "seeds": 2, "heavy": 12}, {"heavy": 1},
    {"ids": 4, "most": 5, "seeds": 1},
])
def test_small_blocks_and_heavy_ids(spark, options):
    """Bounds, seeds, larger blocks where there are too many, and ids that fit no block change nothing."""
    matrix = skewed(3)
    matrix[50, 1:] = 1.0
    vectors = S.cut_lineage(S.unit_vectors(long_form(spark, matrix), "id", "dim", "x"))
    for queries in (vectors, S.cut_lineage(vectors.where("id % 2 = 0"))):
        wanted = range(0, 90, 1 if queries is vectors else 2)
        got = S.block_top_k(queries, vectors, 7, **options).collect()
        assert {(r.qid, r.vid): r.sim for r in got} == pytest.approx(brute_force(matrix, 7, wanted), abs=2e-9)


def test_one_id_with_a_third_of_all_entries(spark):
    """A heavy id is in no block; its products are sums over a join."""
    rng = np.random.default_rng(8)
    matrix = np.where(rng.random((60, 900)) < 0.02, rng.integers(1, 6, (60, 900)), 0).astype(float)
    matrix[17] = 1.0
    vectors = S.cut_lineage(S.unit_vectors(long_form(spark, matrix), "id", "dim", "x"))
    light = vectors.where("id != 17")
    assert light.count() < 2 * 900
    got = S.block_top_k(vectors, vectors, 5, heavy=200).collect()
    assert {(r.qid, r.vid): r.sim for r in got} == pytest.approx(brute_force(matrix, 5), abs=2e-9)
    sizes = B.packed(B.rows_of(light), entries=100).select(F.max(F.size("ws"))).first()[0]
    assert sizes < 200  # a block and the entries of one more id


def test_small_slabs(spark, monkeypatch):
    matrix = skewed(6)
    rows, cols = np.nonzero(matrix)
    order = np.argsort(cols, kind="stable")
    tile = rows[order], cols[order], matrix[rows, cols][order]
    for name, value in (("SLAB", 3), ("EXPANSION", 11)):
        monkeypatch.setattr(B, name, value)
    assert np.allclose(B.product(tile, tile, (90, 90), 60), matrix @ matrix.T)


def groups(seed, signed):
    """Vectors in groups with dimensions of their own, or around a few directions and of many lengths."""
    rng = np.random.default_rng(seed)
    if signed:
        return rng.normal(size=(8, 8))[np.arange(240) % 8] * np.exp(rng.normal(size=(240, 1)) * 2)
    out = np.zeros((240, 80))
    for i in range(240):
        out[i, i % 8 * 10:i % 8 * 10 + 10] = rng.random(10)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_bounds_skip_most_blocks(spark):
    """Of alike blocks only those are sent that can still change a list, and fewer yet are multiplied."""
    matrix = groups(1, False)
    blocks = B.packed(B.rows_of(S.cut_lineage(long_form(spark, matrix).withColumnRenamed("x", "w"))), ids=10)
    numbers, envelopes = B._envelopes(blocks)
    first = B._compare(blocks, blocks, B._pairs(blocks, numbers, envelopes, 4), 8, 5, True, True)
    later = B._pairs(blocks.join(first, "block"), numbers, envelopes, 4)
    assert len(numbers) >= 24 and later.count() < 0.2 * len(numbers) * (len(numbers) - 4)
    got = B.search(blocks, blocks, 5, seeds=4).collect()
    assert {(r.qid, r.vid): r.sim for r in got} == pytest.approx(brute_force(matrix, 5), abs=2e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_never_cut_a_better_match(seed):
    """One query block against many index blocks: skipped ones hold nothing, whatever the signs."""
    for signed in (False, True):
        matrix = groups(seed, signed)
        dims = np.tile(np.arange(matrix.shape[1]), 10)
        asked = matrix[:80:8]
        query = B.QueryBlock(np.arange(10), np.full(10, matrix.shape[1]), dims, asked.ravel(), 3, not signed, False)
        near = np.argsort(-(asked @ matrix.T).max(0))
        for part in np.split(near, 24):
            ws = matrix[part].ravel()
            envelope = B.bucket_norms(np.repeat(np.arange(10), matrix.shape[1]), dims, ws, 10).max(0)
            query.meet(part, np.full(10, matrix.shape[1]), dims, ws, envelope)
        sims = np.round(asked @ matrix.T, 9)
        assert query.skipped > (20 if signed else 0)
        for i in range(10):
            best = sorted(range(240), key=lambda j: (-sims[i, j], j))[:3]
            assert list(query.vid[query.row == i]) == [j for j in best if signed or sims[i, j] > 0]


def test_copies_are_compared_once(spark):
    matrix = skewed(4)
    vectors = S.cut_lineage(S.unit_vectors(long_form(spark, matrix), "id", "dim", "x"))
    classes = S.cut_lineage(S.profile_classes(vectors))
    sizes = sorted((r["count"] for r in classes.groupBy("class").count().collect()), reverse=True)
    assert sizes[0] >= len(matrix) // 3
    distinct = S.cut_lineage(vectors.join(classes.where("id = class").select("id"), "id", "left_semi"))
    assert distinct.select("id").distinct().count() == len(sizes)
    for options in ({}, {"short_list": 4}):
        got = S.top_k_of_classes(classes, classes, distinct, 5, **options).collect()
        assert {(r.qid, r.vid): r.sim for r in got} == pytest.approx(brute_force(matrix, 5), abs=2e-9)


@pytest.mark.parametrize("options", [{}, {"ids": 6, "seeds": 1}])
def test_signed_dense_vectors_keep_every_candidate(spark, options):
    rng = np.random.default_rng(5)
    users, items = rng.normal(size=(20, 4)), rng.normal(size=(30, 4))
    users[3] = 0

    def table(m):
        return spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(len(m))], "id int, ws array<double>")

    got = S.dense_top_k(table(users), table(items), 6, **options).collect()
    sims = np.round(users @ items.T, 9)
    expected = {(i, j): sims[i, j] for i in range(20) for j in sorted(range(30), key=lambda j: (-sims[i, j], j))[:6]}
    assert {(r.qid, r.vid): r.sim for r in got} == pytest.approx(expected, abs=2e-9)
    assert S.dense_top_k(table(users), table(items).limit(0), 6).count() == 0


def test_text_ids_and_dimensions(spark):
    matrix = skewed(9, n=40)
    long = long_form(spark, matrix)
    named = long.select(F.format_string("v%03d", "id").alias("id"), F.format_string("d%d", "dim").alias("dim"), "x")
    vectors = S.cut_lineage(S.unit_vectors(named, "id", "dim", "x"))
    got = S.block_top_k(vectors, vectors, 5, ids=6, seeds=2).collect()
    assert {(int(r.qid[1:]), int(r.vid[1:])): r.sim for r in got} == pytest.approx(brute_force(matrix, 5), abs=2e-9)


@pytest.mark.parametrize("block", [1, 7, 500])
def test_short_lists_are_sent_to_blocks_of_queries(spark, block, monkeypatch):
    """No plan joins pairs: rows sent are lists per block, and every block size gives the exact neighbours."""
    monkeypatch.setattr(short_lists, "QUERIES", block)
    rng = np.random.default_rng(block)
    matrix = np.where(rng.random((80, 60)) < 0.05, rng.integers(1, 6, (80, 60)), 0).astype(float)
    assert search(spark, matrix, 4, cells_per_pair=0) == pytest.approx(brute_force(matrix, 4), abs=2e-9)
    vectors = S.cut_lineage(S.unit_vectors(long_form(spark, matrix), "id", "dim", "x"))
    found = S.top_k(vectors, vectors, 4, cells_per_pair=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "(qid" not in plan.split("MapInArrow", 1)[1]


def test_groups_of_query_blocks_are_sent_an_index_block_once(spark, monkeypatch):
    """What is sent is groups times index blocks, not the square of the blocks; lists are exact for every grouping."""
    monkeypatch.setattr(B, "GROUPS", 3)
    matrix = skewed(10)
    blocks = B.packed(B.rows_of(S.cut_lineage(S.unit_vectors(long_form(spark, matrix), "id", "dim", "x"))), ids=5)
    groups, made = B._groups(blocks)
    pairs = B._pairs(blocks, *B._envelopes(blocks), 4)
    assert blocks.count() >= 18 and made < 6 and groups.count() == blocks.count()
    sent = pairs.join(groups, "qb").select("part", "vb").distinct().count()
    assert sent <= made * blocks.count() and sent < pairs.count()
    got = B.search(blocks, blocks, 5, seeds=4).collect()
    assert {(r.qid, r.vid): r.sim for r in got} == pytest.approx(brute_force(matrix, 5), abs=2e-9)


@pytest.mark.parametrize("block", [None, 5])
def test_all_are_compared_without_vectors_in_long_form(spark, block):
    """Lists travel once a block with marks of who asks; copies, ties and text ids come out as by brute force."""
    rng = np.random.default_rng(8)
    matrix = np.where(rng.random((70, 120)) < 0.05, rng.integers(1, 4, (70, 120)), 0).astype(float)
    matrix[40:45] = matrix[3]
    entries = long_form(spark, matrix).cache()
    found = short_lists.nearest_of_all(entries, 4, 64, 0, 1000, block)
    expected = brute_force(matrix, 4)
    got = {(r.qid, r.vid): r.sim for r in found.collect()}
    assert got == pytest.approx(expected, abs=2e-9)
    for q, ranks in found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "sim", "vid")))).collect():
        assert [r.rank for r in ranks] == list(range(1, len(ranks) + 1))
        assert [(-r.sim, r.vid) for r in ranks] == sorted((-r.sim, r.vid) for r in ranks)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    named = short_lists.nearest_of_all(entries.selectExpr("lpad(id, 3, '0') AS id", "dim", "x"), 4, 64, 0, 1000, block)
    assert {(int(r.qid), int(r.vid)) for r in named.collect()} == set(expected)
    for limits in ((1, 0, 1000), (64, 0, 2), (64, 1e9, 1000)):
        assert short_lists.nearest_of_all(entries, 4, *limits) is None
    assert short_lists.nearest_of_all(entries.limit(0), 4, 64, 0, 1000) is None


def test_few_longer_lists_do_not_shuffle_pairs(spark):
    """One dimension over the limit among many short ones is no reason to join all lists pair by pair."""
    rng = np.random.default_rng(9)
    matrix = np.where(rng.random((150, 400)) < 0.01, rng.integers(1, 4, (150, 400)), 0).astype(float)
    matrix[:20, 7] = 2.0
    entries = long_form(spark, matrix).cache()
    assert (matrix > 0).sum(0).max() > 8
    found = short_lists.nearest_of_all(entries, 5, 8, 0, 1000, 16)
    assert {(r.qid, r.vid): r.sim for r in found.collect()} == pytest.approx(brute_force(matrix, 5), abs=2e-9)
