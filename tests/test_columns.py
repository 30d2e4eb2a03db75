import pytest
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.functions import filters
from shelfwise.functions.messages import encode_message, parse_message, route_topic, stamp_if_missing
from shelfwise.operators import aggregates as A
from shelfwise.schemas import RAW_EVENT


def values(spark, data, schema, expression):
    df = spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in data], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_price_numeric(spark):
    got = values(spark, ["15.990.000đ", "29.990.000đ", "N/A", None], "p string", C.price_numeric("p"))
    assert got == [15990000.0, 29990000.0, None, None]


def test_sold_numeric(spark):
    texts = ["1k2", "2k5", "1k8", "950", "12k", "1,5k", "2.5K", "N/A", None, "1k2 sold", "12k sold"]
    got = values(spark, texts, "s string", C.sold_numeric("s"))
    assert got == [1200.0, 2500.0, 1800.0, 950.0, 12000.0, 1500.0, 2500.0, None, None, 1200.0, 12000.0]


def test_popularity_score(spark):
    got = values(spark, [(4.8, 1200.0), (4.9, 2500.0), (4.9, 1800.0)], "r double, s double", C.popularity_score("r", "s"))
    assert got == pytest.approx([5.76, 12.25, 8.82])


def test_sentiment_and_label(spark):
    got = values(spark, [5, 4, 3, 2, None], "r int", C.sentiment_score("r"))
    assert got == [1.0, 1.0, 0.0, -1.0, -1.0]
    assert values(spark, [0.2, -0.1, 0.0], "s double", C.sentiment_label("s")) == ["positive", "negative", "neutral"]


def test_review_weight(spark):
    assert values(spark, [101, 100, 51, 50], "n int", C.review_weight("n")) == [2.0, 1.5, 1.5, 1.0]


def test_action_weight(spark):
    got = values(spark, ["purchase", "add_to_cart", "view", "zoom", None], "a string", C.action_weight("a"))
    assert got == [5.0, 3.0, 1.0, 0.0, 0.0]
    assert values(spark, ["view", "zoom"], "a string", C.action_weight("a", {"zoom": 2.0})) == [0.0, 2.0]


def test_product_id_from_url(spark):
    urls = ["https://x/some-i-name-i.12.345?sp=1", "https://x/product/99", "https://x/about", None]
    assert values(spark, urls, "u string", C.product_id_from_url("u")) == ["12.345", "99", None, None]


def test_product_features(spark):
    data = [("Phone", "Acme", "phones", "fast"), ("Phone", None, None, None), ("", None, None, " ")]
    got = values(spark, data, "n string, b string, c string, d string", C.product_features("n", "b", "c", "d"))
    assert got[0] == "Phone Acme phones fast" and got[1].strip() == "Phone" and got[2] == ""


def test_price_band_and_histogram(spark):
    prices = [15_990_000.0, 19_490_000.0, 32_990_000.0, 5_990_000.0, 5_000_000.0]
    assert values(spark, prices, "p double", C.price_band("p")) == [2, 2, 3, 1, 1]
    df = spark.createDataFrame([(p,) for p in prices[:4]], "price_numeric double")
    got = {r.band: r.product_count for r in A.price_histogram(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1}


def test_star_bucket(spark):
    assert values(spark, [4.5, 0.4, 5.4, 5.5, 1.0], "r double", C.star_bucket("r")) == [5, None, 5, None, 1]


def test_flexible_dates(spark):
    texts = ["2024-01-31", "2024/01/31", "1706659200000", "soon", None]
    got = [str(d) for d in values(spark, texts, "t string", C.parse_flexible_date("t"))]
    assert got == ["2024-01-31", "2024-01-31", "2024-01-31", "None", "None"]


def test_best_algorithm(spark):
    data = [(0.75, 0.80, 0.82), (0.8, 0.8, 0.8), (0.9, 0.9, 0.8), (0.1, 0.5, 0.2)]
    got = values(spark, data, "cf double, mf double, hybrid double", C.best_algorithm())
    assert got == ["hybrid", "hybrid", "cf", "mf"]


def test_recommendation_score(spark):
    data = [(0.85, 5.76), (0.72, 12.25), (0.82, 5.76), (0.92, 12.25)]
    got = values(spark, data, "s double, p double", C.recommendation_score("s", "p"))
    assert got == pytest.approx([4.896, 8.82, 4.7232, 11.27])


def test_facet_filter_is_inclusive_at_both_ends(spark):
    df = spark.createDataFrame([(1, "a", 15_000_000.0, 4.0), (2, "b", None, None)],
                               "product_id int, category string, price_numeric double, rating double")
    assert filters.facet_filter(df, price_range=(5e6, 15e6)).count() == 1
    assert filters.facet_filter(df, price_range=(15e6, 30e6)).count() == 1
    assert [r.product_id for r in filters.facet_filter(df, price_range=(0.0, 5e6)).collect()] == [2]
    assert filters.facet_filter(df, "a", (0.0, None), 4.0).count() == 1
    assert filters.facet_filter(df).count() == 2


def test_messages_round_trip_and_keep_bad_rows(spark):
    rows = spark.createDataFrame([("u1", "p1", "view", None)], RAW_EVENT)
    sent = encode_message(rows, "user_id")
    assert sent.first().key == "u1"
    bad = spark.createDataFrame([("k", "{not json")], "key string, value string")
    parsed = parse_message(sent.unionByName(bad), RAW_EVENT).collect()
    assert (parsed[0].user_id, parsed[0].action, parsed[0]._corrupt_record) == ("u1", "view", None)
    assert parsed[1].user_id is None and parsed[1]._corrupt_record == "{not json"


def test_stamp_and_route(spark):
    df = spark.createDataFrame([("t1",), (None,)], "timestamp string")
    assert [r[0] for r in stamp_if_missing(df, as_of=F.lit("now")).collect()] == ["t1", "now"]
    assert [r[0] for r in stamp_if_missing(spark.range(1), as_of=F.lit("now")).select("timestamp").collect()] == ["now"]
    paths = ["/reviews/user_products.json", "/x/Review_1.json", "/x/behavior.json", "/x/misc.json"]
    assert values(spark, paths, "p string", route_topic(F.col("p"))) == [
        "products", "reviews", "user_behavior", "products"]
