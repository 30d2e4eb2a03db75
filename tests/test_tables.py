import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators import aggregates as A
from shelfwise.operators import evaluation as E
from shelfwise.operators import interactions as I
from shelfwise.operators import ranking as R
from shelfwise.operators import snapshots as S
from shelfwise.operators.ids import index_ids, ordinal_ids
from shelfwise.operators.quantiles import exact_percentile
from shelfwise.sources.keyed import KeyedTable

BEHAVIOR = "user_id string, product_id string, action_frequency int, interaction_score double"


@pytest.fixture(scope="module")
def behavior(spark):
    return spark.createDataFrame([
        ("user123", "123456789", 3, 9.0), ("user123", "987654321", 1, 1.0),
        ("user456", "987654321", 4, 14.0), ("user456", "123456789", 2, 6.0),
        ("user789", "123123123", 3, 8.0), ("user789", "456456456", 2, 5.0),
    ], BEHAVIOR)


def test_interactions_equal_the_join_of_two_aggregates(spark):
    events = spark.createDataFrame(
        [("u", "p", a) for a in ["view", "view", "purchase", "zoom"]] + [("u", "q", "add_to_cart")],
        "user_id string, product_id string, action string")
    joined = I.action_frequency(events).join(I.interaction_score(events), I.PAIR)
    assert rows(I.interactions(events)) == rows(joined) == [("u", "p", 4, 7.0), ("u", "q", 1, 3.0)]


def test_user_and_product_summaries(behavior):
    assert rows(A.user_behavior_analysis(behavior)) == [
        ("user123", 4, 5.0), ("user456", 6, 10.0), ("user789", 5, 6.5)]
    popular = A.popular_products(behavior).orderBy(F.desc("total_interaction"), "product_id").collect()
    assert [tuple(r) for r in popular] == [
        ("123456789", 5, 15.0), ("987654321", 5, 15.0), ("123123123", 3, 8.0), ("456456456", 2, 5.0)]


def test_products_by_category(spark):
    df = spark.createDataFrame([
        ("phones", 15_990_000.0, 4.8), ("phones", 29_990_000.0, 4.9), ("phones", 12_490_000.0, 4.7),
        ("laptops", 32_990_000.0, 4.8), ("audio", 5_990_000.0, 4.9),
    ], "category string, price_numeric double, rating double")
    got = {r.category: (r.product_count, r.avg_price, round(r.avg_rating, 6)) for r in A.products_by_category(df).collect()}
    assert got == {"phones": (3, 19_490_000.0, 4.8), "laptops": (1, 32_990_000.0, 4.8), "audio": (1, 5_990_000.0, 4.9)}


def test_popularity_baseline(spark, behavior):
    products = spark.createDataFrame(
        [("123456789", "a", "p", 4.8, 5.76), ("987654321", "b", "p", 4.9, 12.25)],
        "product_id string, name string, price string, rating double, popularity_score double")
    got = {(r.user_id, r.product_id): r.recommendation_score for r in I.popularity_baseline(behavior, products).collect()}
    assert got == pytest.approx({
        ("user123", "123456789"): 51.84, ("user123", "987654321"): 12.25,
        ("user456", "987654321"): 171.5, ("user456", "123456789"): 34.56})


def test_enrich_with_defaults(spark):
    recs = spark.createDataFrame([("u", "known"), ("u", "gone")], "user_id string, product_id string")
    products = spark.createDataFrame([("known", "n", "1đ", None, 2.0)],
                                     "product_id string, name string, price string, rating double, popularity_score double")
    assert rows(I.enrich_with_defaults(recs, products)) == [
        ("u", "gone", "Product gone", "Unknown", 0.0, 1.0), ("u", "known", "n", "1đ", None, 2.0)]


def test_matrix_averages_or_sums_duplicates(spark):
    df = spark.createDataFrame([("u", 1, 2.0), ("u", 1, 4.0), ("v", 2, 5.0)],
                               "user_id string, product_id int, interaction_score double")
    assert rows(A.interaction_matrix(df, [1, 2])) == [("u", 3.0, 0.0), ("v", 0.0, 5.0)]
    assert rows(A.interaction_matrix(df, [1, 2], average=False)) == [("u", 6.0, 0.0), ("v", 0.0, 5.0)]


def test_rating_profile_is_zero_without_reviews(spark):
    products = spark.createDataFrame([("a",), ("b",)], "product_id string")
    reviews = spark.createDataFrame([("a", 5), ("a", 5), ("a", 1), ("a", 3)], "product_id string, rating int")
    got = {r.product_id: r for r in A.product_rating_profile(products, reviews).collect()}
    assert (got["a"].total, got["a"].stars_5, got["a"].pct_5) == (4, 2, 50.0)
    assert (got["b"].total, got["b"].pct_5) == (0, 0.0)
    assert {r.stars: r.review_count for r in A.global_rating_histogram(reviews).collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 2}


def test_pages(spark):
    df = spark.range(25).select(
        F.col("id").alias("product_id"), (F.col("id") % 5).cast("double").alias("popularity_score"),
        F.lit(None).cast("double").alias("price_numeric"), F.lit(1.0).alias("rating"))
    pages = [[r.product_id for r in R.paginate(df, p).collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [12, 12, 1, 0]
    assert sum(pages, []) == [r.product_id for r in R.list_products(df).collect()]
    assert tuple(R.page_count(df).first()) == (25, 3, 3)
    with pytest.raises(ValueError):
        R.list_products(df, "newest")


def test_top_n_limits_before_the_shuffle(spark, behavior):
    best = R.top_n(behavior, "user_id", "interaction_score", "product_id", 1)
    assert rows(best, "user_id", "product_id") == [
        ("user123", "123456789"), ("user456", "987654321"), ("user789", "123123123")]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_latest_merge_upsert_delete(spark):
    schema = "id int, v string, ts int"
    batch = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], schema)
    version = [F.col("ts")]
    merged = [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
    assert rows(S.merged_view(batch, new, ["id"], version)) == merged
    assert rows(S.merged_view(batch, None, ["id"], version)) == rows(batch)
    assert rows(S.merged_view(None, new, ["id"], version)) == rows(new)
    with pytest.raises(ValueError):
        S.merged_view(None, None, ["id"], version)
    extra = new.withColumn("more", F.lit(1))
    assert rows(S.merged_view(batch, extra, ["id"], version), "id", "more") == [(1, None), (2, 1), (3, 1)]
    assert rows(S.upsert(batch, new, "id", version)) == merged
    assert rows(S.accumulate([batch, new, new], ["id", "ts"])) == [(1, "a", 1), (2, "b", 1), (2, "c", 2), (3, "d", 2)]
    assert rows(S.delete_documents(batch, spark.createDataFrame([(2,), (9,)], "id int"), "id")) == [(1, "a", 1)]
    assert rows(S.latest_run(batch.unionByName(new), "ts")) == rows(new)


def test_keyed_table_rewrites_only_changed_buckets(spark, tmp_path):
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    table = KeyedTable(spark, str(tmp_path / "t"), "id", T.LongType(), [F.col("ts")], buckets=16)
    table.create(spark.range(200).select("id", F.lit("a").alias("v"), F.lit(1).alias("ts")))
    before = files()
    table.upsert(spark.createDataFrame([(3, "b", 2), (3, "c", 3), (500, "d", 1), (4, "old", 0)], "id long, v string, ts int"))
    now = {r.id: r.v for r in table.read().collect()}
    assert now == {k: "a" for k in range(200)} | {3: "c", 500: "d"}
    kept = [f for f, t in files().items() if before.get(f) == t]
    places = {f.split("_bucket=")[1].split("/")[0] for f in before}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in kept}) >= len(places) - 3
    assert rows(table.get(3)) == [(3, "c", 3)] and table.get(201).count() == 0
    assert "PartitionFilters: [isnotnull(_bucket" in table.get(3)._jdf.queryExecution().toString()
    table.delete(spark.createDataFrame([(3,), (999,)], "id long"))
    assert table.read().count() == 200 and table.get(3).count() == 0
    one = KeyedTable(spark, str(tmp_path / "one"), "id", T.LongType(), [F.col("ts")], buckets=4)
    one.create(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, ts int"))
    one.delete(spark.createDataFrame([(1,)], "id long"))
    assert rows(one.read()) == [(2, "b", 1)]


def test_dense_ids(spark):
    df = spark.range(0, 5000).select((F.col("id") % 1700).cast("string").alias("name")).repartition(7)
    ids = index_ids(df, "name", "n", buckets=16).collect()
    assert sorted(r.n for r in ids) == list(range(1700)) and len({r.name for r in ids}) == 1700
    again = index_ids(df.repartition(3), "name", "n", buckets=16)
    assert rows(again) == sorted((tuple(r) for r in ids), key=str)
    placed = ordinal_ids(spark.range(10).select((-F.col("id")).alias("x")).repartition(4), ["x"])
    assert [(r.x, r.doc_id) for r in placed.orderBy("doc_id").collect()] == [(i - 9, i) for i in range(10)]


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_percentile_is_exact_on_skewed_groups(spark, fraction):
    rng = np.random.default_rng(3)
    data = {"hot": np.exp(rng.normal(0, 3, 6000)), "same": np.full(500, 2.5), "one": np.array([7.0]),
            "few": np.array([1.0, 2.0, 4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r.g: r.p for r in exact_percentile(df, "g", "v", fraction, "p").collect()}
    assert got == pytest.approx({g: np.percentile(v, fraction * 100) for g, v in data.items()})


def test_latency_summary_scans_three_times(spark, tmp_path):
    rng = np.random.default_rng(5)
    made = [(f"e{i % 3}", i % 7 > 0, float(t), f"2024-01-01 00:{i % 60:02d}:00") for i, t in enumerate(rng.exponential(2, 3000))]
    made += [("down", False, 1.0, "2024-01-01 00:00:00")]
    spark.createDataFrame(made, "endpoint string, success boolean, response_time double, ts string").write.parquet(str(tmp_path / "r"))
    requests = spark.read.parquet(str(tmp_path / "r"))
    summary = E.latency_summary(requests)
    got = {r.endpoint: r for r in summary.collect()}
    for e in ("e0", "e1", "e2"):
        assert got[e].p95_time == pytest.approx(np.percentile([t for n, ok, t, _ in made if n == e and ok], 95))
    assert got["down"].p95_time is None and got["down"].success_rate == 0
    # One scan is behind the stored aggregate, the others are in the plan.
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def test_ranking_metrics(spark):
    listed = spark.createDataFrame(
        [("cf", "u", i) for i in range(4)] + [("mf", "u", 9), ("cf", "v", 1)],
        "algorithm string, user_id string, product_id int")
    relevant = spark.createDataFrame([("u", 0), ("u", 1), ("w", 5)], "user_id string, product_id int")
    got = {r.algorithm: r for r in E.ranking_metrics(listed, relevant).collect()}
    assert (got["cf"].precision, got["cf"].recall) == (0.25, 0.5)
    assert got["cf"].f1 == pytest.approx(1 / 3) and got["mf"].f1 == 0.0


def test_comparisons(spark):
    recs = spark.createDataFrame(
        [("u", 1, "cf", 0.9), ("u", 1, "hybrid", 0.8), ("u", 2, "cf", 0.5), ("u", 3, "mf", None)],
        "user_id string, product_id int, algorithm string, score double")
    best = E.compare_algorithms(recs, ("cf", "mf", "hybrid"), "u", 1)
    assert rows(best, "algorithm", "product_id") == [("cf", 1), ("hybrid", 1)]
    table = {r.product_id: (r.cf, r.mf, r.hybrid, r.best_algorithm) for r in E.product_score_table(recs).collect()}
    assert table[1] == (0.9, 0.0, 0.8, "cf") and table[2] == (0.5, 0.0, 0.0, "cf")
