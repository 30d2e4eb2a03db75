import tracemalloc

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.operators import als as L
from shelfwise.operators import factors as M
from shelfwise.operators import hybrid as H
from shelfwise.operators import neighbours as N
from shelfwise.operators import small_side
from shelfwise.operators.content import similar_products
from shelfwise.operators.shared import shared_dims

USERS = ["u123", "u456", "u789", "u101"]
ITEMS = ["A", "B", "C", "D", "E"]
DEMO = np.array([[5, 3, 0, 0, 0], [0, 4, 2, 0, 0], [1, 0, 0, 5, 0], [0, 0, 0, 0, 4]], dtype=float)


@pytest.fixture(scope="module")
def demo(spark):
    cells = [(USERS[i], ITEMS[j], 1, float(DEMO[i, j])) for i, j in zip(*np.nonzero(DEMO))]
    return spark.createDataFrame(cells, "user_id string, product_id string, action_frequency int, interaction_score double")


def test_user_similarity(demo):
    got = {(r.user_id, r.neighbour_id): r.similarity for r in N.user_similarity(demo).collect()}
    pairs = {("u123", "u456"): 0.460179, ("u123", "u789"): 0.168168}
    assert got == pytest.approx({**pairs, **{(b, a): s for (a, b), s in pairs.items()}}, abs=1e-6)


def test_knn_recommend(demo):
    got = {(r.user_id, r.product_id): r.cf_score for r in N.knn_recommend(demo).collect()}
    assert got == pytest.approx({("u123", "C"): 0.920358, ("u123", "D"): 0.840841, ("u456", "A"): 2.300895,
                                 ("u789", "B"): 0.504505}, abs=1e-6)


def test_knn_sweep_follows_threshold(demo):
    swept = {(r.k, r.threshold): r.avg_recommendations for r in N.knn_sweep(demo).collect()}
    assert len(swept) == 9
    assert swept[(5, 0.2)] == 0.5 and swept[(20, 0.4)] == 0.5
    assert {(r.k, r.threshold): r.avg_recommendations for r in N.knn_sweep(demo, (1,), (0.1, 0.5)).collect()} == {
        (1, 0.1): 0.75, (1, 0.5): 0.0}


def test_hybrid_demo(spark):
    """Both users have seen the same two products: only content is left to recommend from."""
    behavior = spark.createDataFrame(
        [("u1", "A", 1, 9.0), ("u1", "B", 1, 1.0), ("u2", "B", 1, 14.0), ("u2", "A", 1, 6.0)],
        "user_id string, product_id string, action_frequency int, interaction_score double")
    words = {"A": "red phone fast", "B": "blue phone", "C": "red phone", "D": "blue lamp", "E": "green sofa phone"}
    products = spark.createDataFrame(
        [(i, w, "b", "c", None, "1đ", 4.0, 2.0) for i, w in words.items()],
        "product_id string, name string, brand string, category string, description string, price string, "
        "rating double, popularity_score double")
    assert N.user_similarity(behavior).first().similarity == pytest.approx(0.493013, abs=1e-6)
    got = H.hybrid_all_users(behavior, products).collect()
    mine = [r for r in got if r.user_id == "u1"]
    assert {r.product_id for r in mine} == {"C", "D", "E"}
    assert all(r.cf_score == 0 and r.hybrid_score == pytest.approx(0.3 * r.cb_score) for r in mine)
    assert all(r.recommendation_score == pytest.approx(2 * r.hybrid_score) for r in mine)


def test_hybrid_drops_touched_products_even_at_score_zero(spark):
    scores = spark.createDataFrame([("u", "p", 2.0), ("u", "q", 1.0), ("v", "p", 0.0)],
                                   "user_id string, product_id string, cb_score double")
    assert rows(H.max_normalise(scores, "cb_score")) == [("u", "p", 1.0), ("u", "q", 0.5), ("v", "p", 0.0)]
    cf = scores.select("user_id", "product_id", F.col("cb_score").alias("cf_score")).where("product_id = 'p'")
    merged = H.merge_candidates(scores, cf)
    assert rows(merged) == [("u", "p", 2.0, 2.0), ("u", "q", 1.0, 0.0), ("v", "p", 0.0, 0.0)]
    touched = spark.createDataFrame([("u", "p", 1, 0.0)],
                                    "user_id string, product_id string, action_frequency int, interaction_score double")
    products = spark.createDataFrame([("p", "n", "1đ", 1.0, 1.0)],
                                     "product_id string, name string, price string, rating double, popularity_score double")
    blended = H.hybrid_blend(touched, products, scores, cf, 1)
    # q wins u's only place but is unknown; nothing moves up.
    assert rows(blended, "user_id", "product_id") == [("v", "p")]


def test_similar_products_with_many_copies(spark):
    names = ["red ring"] * 40 + ["blue ring", "green bolt", "red bolt"]
    products = spark.createDataFrame([(i, n, None, None, None) for i, n in enumerate(names)],
                                     "product_id int, name string, brand string, category string, description string")
    wanted = products.where("product_id in (0, 39, 41)").select("product_id")
    got = {}
    for r in similar_products(products, wanted, 3).orderBy("rank").collect():
        got.setdefault(r.product_id, []).append((r.similar_id, round(r.similarity, 6)))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and got[39] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert [i for i, _ in got[41]] == [42]


def cosine(users, items):
    def unit(m):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 1e-12)
    return unit(users) @ unit(items).T


def test_svd_on_the_demo_matrix(demo):
    cells = M.matrix(demo)
    _, _, singular = M.svd_factors(cells, 10)
    assert singular == pytest.approx([6.486714, 5.03018, 4.0, 3.55244], abs=1e-5)
    users, items, _ = M.svd_factors(cells, 2)
    got = {(r.user_id, r.product_id): r.mf_score for r in M.factor_cosine_top(users, items, 5).collect()}
    expected = [[.9797, .950162, .83878, .092766, 0], [.853985, .999599, .973576, -.249788, 0],
                [.414111, -.091784, -.343489, .991271, 0], [0, 0, 0, 0, 0]]
    for i, user in enumerate(USERS):
        for j, item in enumerate(ITEMS):
            assert got[(user, item)] == pytest.approx(expected[i][j], abs=1e-5)


@pytest.mark.parametrize("small_values", [0, 600, M.SMALL_VALUES])
def test_svd_agrees_with_a_dense_solver(spark, small_values):
    rng = np.random.default_rng(1)
    dense = np.outer(rng.random(40), rng.random(25)) * 9 + np.outer(rng.random(40), rng.random(25)) * 4
    cells = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(40) for j in range(25)],
                                  "row int, col int, value double")
    users, items, singular = M.svd_factors(cells, 2, steps=3, small_values=small_values)
    exact = np.linalg.svd(dense)
    assert singular == pytest.approx(exact[1][:2], rel=1e-8)
    u = np.array([r[1:] for r in users.orderBy("id").collect()])
    v = np.array([r[1:] for r in items.orderBy("id").collect()])
    assert np.allclose(u @ v.T, dense, atol=1e-6)
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-8)


def multiplicative(dense, k, steps):
    """Loss of multiplicative updates, the usual way."""
    rng = np.random.default_rng(42)
    w, h = (rng.random((n, k)) * 2 * np.sqrt(dense.mean() / k) for n in dense.shape)
    for _ in range(steps):
        w *= dense @ h / (w @ (h.T @ h) + 1e-12)
        h *= dense.T @ w / (h @ (w.T @ w) + 1e-12)
    return ((dense - w @ h.T) ** 2).sum()


def dense_loss(users, items, dense):
    w, h = (np.array([r[1:] for r in side.orderBy("id").collect()]) for side in (users, items))
    assert min(w.min(), h.min()) >= 0
    return float(((dense - w @ h.T) ** 2).sum())


@pytest.mark.parametrize("shape", [(40, 25), (25, 40)])
def test_nmf_beats_two_hundred_multiplicative_steps(spark, shape):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random(shape) < 0.4, rng.integers(1, 9, shape), 0).astype(float)
    dense[0], dense[:, 0] = np.arange(shape[1]) + 1, np.arange(shape[0]) + 1  # no empty row or column
    cells = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], "row int, col int, value double")
    users, items, losses = M.nmf_factors(cells, 4)
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:])) and len(losses) <= M.NMF_STEPS >= 200
    assert dense_loss(users, items, dense) <= 1.01 * multiplicative(dense, 4, 200)


def test_nmf_without_a_small_side(spark):
    """Both sides as tables: the same steps, the same losses."""
    rng = np.random.default_rng(4)
    dense = rng.integers(1, 9, (20, 12)).astype(float)
    cells = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(20) for j in range(12)], "row int, col int, value double")
    users, items, losses = M.nmf_factors(cells, 3, steps=3, tolerance=-1)
    tables = M.nmf_factors(cells, 3, steps=3, tolerance=-1, small_values=0)
    assert tables[2] == pytest.approx(losses, rel=1e-3)
    assert dense_loss(*tables[:2], dense) == pytest.approx(tables[2][-1], rel=1e-6)


def test_descend_solves_each_row():
    rng = np.random.default_rng(6)
    h, x = rng.random((30, 4)), rng.random((50, 30))
    w = M.descend(x @ h, h.T @ h)
    slope = w @ (h.T @ h) - x @ h  # at the best point: no slope where positive, uphill where zero
    assert (w >= 0).all() and np.abs(slope[w > 0]).max() < 0.02 and slope[w == 0].min() > -0.02


def test_mf_recommend_defaults(demo, spark):
    products = spark.createDataFrame([("A", "first", "1đ", 4.0, 3.0)],
                                     "product_id string, name string, price string, rating double, popularity_score double")
    got = {(r.user_id, r.product_id): r for r in M.mf_recommend(demo, products, "svd", n=2).collect()}
    assert len(got) == 8
    mine = got[("u123", "A")]
    assert mine.name == "first" and mine.recommendation_score == pytest.approx(3 * mine.mf_score)
    other = next(r for (_, p), r in got.items() if p != "A")
    assert other.name == f"Product {other.product_id}" and other.popularity_score == 1.0
    with pytest.raises(ValueError):
        M.mf_recommend(demo, products, "qr")


def test_als_lists_and_error(spark):
    rng = np.random.default_rng(2)
    data = [(f"u{i}", f"p{j}", 1, float(rng.integers(1, 6))) for i in range(30) for j in range(20) if rng.random() < 0.4]
    behavior = spark.createDataFrame(data, "user_id string, product_id string, action_frequency int, interaction_score double")
    ratings, users, items = L.indexed(behavior)
    train, test = L.train_test_split(ratings, ["user_index", "item_index"])
    assert train.count() + test.count() == len(data) and 0 < test.count() < len(data) / 2
    assert rows(L.train_test_split(ratings.repartition(3), ["user_index", "item_index"])[0]) == rows(train)
    model = L.als_fit(train, iterations=3)
    assert L.als_rmse(model, test).first().rmse > 0
    products = spark.createDataFrame([(f"p{j}", "n", "1đ", 1.0, 2.0) for j in range(20)],
                                     "product_id string, name string, price string, rating double, popularity_score double")
    lists = L.als_recommend_all(model, users, items, products, 5).collect()
    assert len(lists) == 5 * model.userFactors.count()
    assert {r.product_id for r in lists} <= {f"p{j}" for j in range(20)}
    own = model.recommendForAllUsers(5).select("user_index", F.inline("recommendations"))
    expected = {(r.user_id, r.product_id): r.rating for r in L.deindex(own, users, items).collect()}
    assert {(r.user_id, r.product_id): r.cf_score for r in lists} == pytest.approx(expected, abs=1e-5)
    swept = L.sweep_table(L.mf_sweep(ratings, ranks=(2, 3), iterations=(2,)), ratings).collect()
    assert sorted(r["rank"] for r in swept) == [2, 3] and all(r.rmse > 0 for r in swept)


def test_power_factors_on_either_way_and_of_low_rank(spark):
    """Fixed steps from given starts: dense arithmetic, small side and tables agree; dependent columns go."""
    rng = np.random.default_rng(7)
    full, low = rng.random((30, 12)), np.outer(rng.random(30), rng.random(12)) + np.outer(rng.random(30), rng.random(12))
    for dense, rank in ((full, 3), (low, 2)):
        cells = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(30) for j in range(12)], "row long, col long, value double")

        def start(item, j):
            return (item * (j + 2) * 7 + j) % 11 - 5

        basis = np.array([[float(start(i, j)) for j in range(3)] for i in range(12)])
        for _ in range(2):
            basis, r = np.linalg.qr(dense.T @ (dense @ basis))
            basis = basis * np.sign(np.diag(r))
        expected = (dense @ basis[:, :rank]) @ basis[:, :rank].T
        for small_values in (0, 1000):
            users, items = M.power_factors(cells, 3, 2, start, small_values)
            u, v = (np.array([r[1:] for r in side.orderBy("id").collect()]) for side in (users, items))
            assert v.shape[1] == rank and np.allclose(v.T @ v, np.eye(rank), atol=1e-8) and np.allclose(u @ v.T, expected, atol=1e-6)


def test_merge_scores(spark):
    one = spark.createDataFrame([("u", "p", 2.0), ("u", "q", 1.0)], "user_id string, product_id string, cf_score double")
    two = spark.createDataFrame([("u", "q", 3.0), ("v", "p", 0.5)], "user_id string, product_id string, mf_score double")
    assert rows(H.merge_scores(one, two)) == [("u", "p", 2.0, 0.0), ("u", "q", 1.0, 3.0), ("v", "p", 0.0, 0.5)]


def test_shared_products_come_from_whole_profiles(spark):
    """No join goes row by row over neighbours' products; negative and zero scores share nothing."""
    behavior = spark.createDataFrame(
        [("u", "a", 1.0), ("u", "b", 2.0), ("v", "b", 1.0), ("v", "a", 0.0), ("w", "c", 1.0)], "user_id string, product_id string, interaction_score double")
    near = spark.createDataFrame([("u", "v"), ("v", "u"), ("u", "w")], "user_id string, neighbour_id string")
    found = N.co_interaction(behavior, near)
    assert rows(found) == [("u", "v", 1), ("v", "u", 1)]
    assert "Explode" not in str(found._jdf.queryExecution()) and "array_intersect" in str(found._jdf.queryExecution())


def test_a_factor_step_holds_a_number_a_cell():
    """Not a row of factors a cell, which for 20 factors was more than 30 times the cells."""
    row = np.repeat(np.arange(2000), 50)
    places, values, factors = np.arange(len(row)) % 70, np.ones(len(row)), np.arange(1400.0).reshape(70, 20)
    tracemalloc.start()
    out = small_side._product(places, values, row, 2000, factors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * values.nbytes and np.allclose(out, [factors[places[row == i]].sum(0) for i in range(2000)])


def test_blend_flags_candidates_of_either_source(spark):
    """One stored table holds both scores and what was touched; repeated behaviour repeats no candidate."""
    pair = "user_id string, product_id string"
    cb = spark.createDataFrame([("u", "p", 0.5), ("u", "q", 0.25)], f"{pair}, cb_score double")
    cf = spark.createDataFrame([("u", "q", 2.0), ("u", "r", 1.0), ("v", "p", 3.0)], f"{pair}, cf_score double")
    touched = spark.createDataFrame([("u", "q"), ("u", "q"), ("v", "p")], pair)
    assert rows(H._flagged(touched, cb, cf)) == [
        ("u", "p", 0.5, None, False), ("u", "q", 0.25, 2.0, True), ("u", "r", None, 1.0, False), ("v", "p", None, 3.0, True)]


def test_factors_go_to_few_item_blocks(spark, monkeypatch):
    """A user with items everywhere is sent to each block; their number follows the ratings and changes no factor."""
    rng = np.random.default_rng(5)
    data = [(i, j, float(rng.integers(1, 6))) for i in range(60) for j in range(40) if rng.random() < 0.5]
    ratings = spark.createDataFrame(data, "user_index int, item_index int, rating float").repartition(3).cache()
    few = L.als_fit(ratings, iterations=4)
    assert few._java_obj.itemFactors().rdd().getNumPartitions() == 2
    swept = L.mf_sweep(ratings, ranks=(2,), iterations=(2,))
    assert swept.bestModel._java_obj.itemFactors().rdd().getNumPartitions() == 2
    monkeypatch.setattr(L, "BLOCK_RATINGS", 200)
    assert L.item_blocks(ratings) == -(-len(data) // 200) and L.item_blocks(ratings.limit(0)) == 2
    monkeypatch.setattr(L, "BLOCK_RATINGS", 1)
    many = L.als_fit(ratings, iterations=4)
    assert many._java_obj.itemFactors().rdd().getNumPartitions() == 10
    for side in ("userFactors", "itemFactors"):
        a, b = (np.array([r.features for r in getattr(m, side).orderBy("id").collect()]) for m in (few, many))
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-4)


def test_all_users_that_share_a_product_are_counted(spark):
    """Not the nearest ten: a user in the middle of a crowd shares products with everybody."""
    rng = np.random.default_rng(3)
    data = [(i, j, float(rng.integers(-1, 3))) for i in range(45) for j in range(12) if rng.random() < 0.4]
    data += [(900, j, 1.0) for j in range(60)] + [(901, 70, 1.0), (902, 70, 0.0)]
    behavior = spark.createDataFrame(data, "user_id long, product_id long, interaction_score double").repartition(3)
    liked = {}
    for i, j, x in data:
        liked.setdefault(i, set()).update([j] if x > 0 else [])
    expected = sorted(((u, v, len(liked[u] & liked[v])) for u in liked for v in liked if u != v and liked[u] & liked[v]), key=str)
    assert sum(u == 900 for u, _, _ in expected) > 40
    assert rows(N.co_interaction(behavior)) == expected
    entries = behavior.where("interaction_score > 0").selectExpr("user_id AS id", "product_id AS dim")
    for options in ({"ids": 4}, {"entries": 9}, {"ids": 7, "heavy": 20}, {"cells_per_pair": 0.0}):
        assert rows(shared_dims(entries, **options)) == expected, options
    named = behavior.selectExpr("'u' || user_id AS user_id", "'p' || product_id AS product_id", "interaction_score")
    assert rows(N.co_interaction(named)) == sorted(((f"u{u}", f"u{v}", n) for u, v, n in expected), key=str)


def test_nobody_shares_anything(spark):
    behavior = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "user_id long, product_id long, interaction_score double")
    assert N.co_interaction(behavior).count() == 0 and N.co_interaction(behavior.limit(0)).count() == 0
