"""Projections, scalar functions and filters."""

from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise.functions import columns as C
from shelfwise.functions import filters
from shelfwise.functions.messages import encode_message, parse_message, route_topic, stamp_if_missing
from shelfwise.operators.interactions import interactions, popularity_baseline
from shelfwise.registry.core import query
from shelfwise.schemas import RAW_EVENT


@query("price_numeric", "SELECT product_id, price, price_numeric FROM products", ("products",))
def _(spark, sf):
    return D.raw_products(spark, sf).select("product_id", "price", C.price_numeric("price").alias("price_numeric"))


@query("sold_numeric", "SELECT product_id, sold, sold_numeric FROM products", ("products",))
def _(spark, sf):
    return D.raw_products(spark, sf).select("product_id", "sold", C.sold_numeric("sold").alias("sold_numeric"))


@query("popularity_score", "SELECT product_id, round(popularity_score, 6) AS popularity_score FROM products",
       ("products",))
def _(spark, sf):
    return D.products(spark, sf).select("product_id", F.round("popularity_score", 6).alias("popularity_score"))


@query("sentiment_score", "SELECT product_id, rating, sentiment_score FROM ratings", ("ratings",))
def _(spark, sf):
    return D.ratings(spark, sf)


@query("comment_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS comment_length FROM documents")
def _(spark, sf):
    return D.load(spark, sf, "documents").select("doc_id", C.comment_length("text").alias("comment_length"))


@query("review_weight", "SELECT review_id, rating, comment_length, review_weight FROM reviews", ("reviews",))
def _(spark, sf):
    return D.reviews(spark, sf).select("review_id", "rating", "comment_length", "review_weight")


@query("action_weight", "SELECT event_id, action, action_weight FROM weighted", ("weighted",))
def _(spark, sf):
    return D.events(spark, sf).select("event_id", "action", C.action_weight("action").alias("action_weight"))


@query("stamp_if_missing", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2024-02-01 00:00:00'
                      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp FROM events""")
def _(spark, sf):
    text = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = D.events(spark, sf).select("event_id", text.alias("timestamp"))
    return stamp_if_missing(rows, as_of=F.lit("2024-02-01 00:00:00"))


@query("product_id_from_url", """
SELECT product_id, regexp_extract(split_part(url, '?', 1), '-i\\.([^/]*)$', 1) AS url_id
FROM raw_products""", ("raw_products",))
def _(spark, sf):
    return D.raw_products(spark, sf).select("product_id", C.product_id_from_url("url").alias("url_id"))


@query("product_features", """
SELECT p_partkey AS product_id,
       concat_ws(' ', coalesce(p_name, ''), coalesce(replace(p_brand, '#', ''), ''), coalesce(p_type, ''), '')
         AS features FROM part""")
def _(spark, sf):
    return D.catalog_text(spark, sf).select(
        "product_id", C.product_features("name", "brand", "category", "description").alias("features")
    )


@query("sentiment_label", """
SELECT product_id, CASE WHEN avg(sentiment_score) > 0 THEN 'positive' WHEN avg(sentiment_score) < 0 THEN 'negative'
                        ELSE 'neutral' END AS label FROM ratings GROUP BY product_id""", ("ratings",))
def _(spark, sf):
    mean = D.ratings(spark, sf).groupBy("product_id").agg(F.avg("sentiment_score").alias("s"))
    return mean.select("product_id", C.sentiment_label("s").alias("label"))


# The data's prices lie between 900,000 and 1,000,000, below the first default cut.
CUTS = (925_000.0, 950_000.0, 975_000.0)
BAND_SQL = """CASE WHEN price_numeric < 925000 THEN 0 WHEN price_numeric < 950000 THEN 1
                   WHEN price_numeric < 975000 THEN 2 WHEN price_numeric >= 975000 THEN 3 END"""


@query("price_band", f"SELECT product_id, price_numeric, {BAND_SQL} AS band FROM products", ("products",))
def _(spark, sf):
    return D.raw_products(spark, sf).withColumn("price_numeric", C.price_numeric("price")).select(
        "product_id", "price_numeric", C.price_band("price_numeric", CUTS).alias("band")
    )


@query("star_bucket", """
SELECT event_id, CASE WHEN floor(value + 0.5) BETWEEN 1 AND 5 THEN CAST(floor(value + 0.5) AS INTEGER) END AS stars
FROM events""")
def _(spark, sf):
    return D.events(spark, sf).select("event_id", C.star_bucket("value").alias("stars"))


@query("fill_unknown", """
SELECT product_id, coalesce(description, 'Unknown') AS description, coalesce(brand, 'Unknown') AS brand
FROM raw_products""", ("raw_products",))
def _(spark, sf):
    return D.catalog_text(spark, sf).select(
        "product_id", C.fill_unknown("description", "Unknown").alias("description"),
        C.fill_unknown("brand", "Unknown").alias("brand"),
    )


@query("parse_flexible_date", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN CAST(epoch_ms(o_orderdate) AS VARCHAR)
    ELSE 'soon' END AS d FROM orders)
SELECT o_orderkey, CAST(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y/%m/%d'),
    make_timestamp(TRY_CAST(d AS BIGINT) * 1000)) AS DATE) AS order_date FROM t""")
def _(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(key % 4 == 2, (F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
                             * 86_400_000).cast("string"))
        .otherwise("soon")
    )
    return D.load(spark, sf, "orders").select("o_orderkey", C.parse_flexible_date(text).alias("order_date"))


@query("parse_message", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, action FROM ev""",
       ("ev",))
def _(spark, sf):
    return parse_message(_event_messages(spark, sf), RAW_EVENT).select("event_id", "user_id", "product_id", "action")


def _event_messages(spark, sf):
    return D.events(spark, sf).select(
        "event_id",
        F.to_json(F.struct(
            F.col("user_id").cast("string").alias("user_id"),
            F.col("product_id").cast("string").alias("product_id"), "action",
        )).alias("value"),
    )


@query("encode_message", """
SELECT CAST(user_id AS VARCHAR) AS key,
       '{"user_id":' || user_id || ',"product_id":' || product_id || ',"action":"' || action || '"}' AS value
FROM ev""", ("ev",))
def _(spark, sf):
    return encode_message(D.events(spark, sf).select("user_id", "product_id", "action"), "user_id")


# Three scores that any engine can compute, for operators that compare scores.
SCORES_SQL = """
SELECT p_partkey AS product_id, (p_partkey % 11) / 10.0 AS cf, (p_size % 11) / 10.0 AS mf,
       (p_partkey * 7 % 11) / 10.0 AS hybrid FROM part"""


@query("best_algorithm", f"""
WITH s AS ({SCORES_SQL})
SELECT product_id, CASE WHEN hybrid >= cf AND hybrid >= mf THEN 'hybrid' WHEN cf >= mf THEN 'cf' ELSE 'mf' END AS best
FROM s""")
def _(spark, sf):
    part = D.load(spark, sf, "part")
    key = F.col("p_partkey")
    scores = part.select(
        key.alias("product_id"), (key % 11 / 10).alias("cf"), (F.col("p_size") % 11 / 10).alias("mf"),
        (key * 7 % 11 / 10).alias("hybrid"),
    )
    return scores.select("product_id", C.best_algorithm("cf", "mf", "hybrid").alias("best"))


@query("nonnegative_clamp", """
SELECT c_custkey, greatest(c_acctbal - 4000, 0.0) AS clamped FROM customer""")
def _(spark, sf):
    return D.load(spark, sf, "customer").select(
        "c_custkey", C.nonnegative_clamp(F.col("c_acctbal") - 4000).alias("clamped")
    )


@query("recommendation_score", """
SELECT user_id, product_id, round(recommendation_score, 6) AS recommendation_score FROM baseline""", ("baseline",))
def _(spark, sf):
    recs = popularity_baseline(interactions(D.events(spark, sf)), D.products(spark, sf))
    return recs.select("user_id", "product_id", F.round("recommendation_score", 6).alias("recommendation_score"))


@query("filter_user", """
SELECT event_id, user_id, product_id, action FROM ev WHERE user_id = 8""", ("ev",))
def _(spark, sf):
    return filters.filter_user(D.events(spark, sf), 8).select("event_id", "user_id", "product_id", "action")


@query("filter_product", "SELECT product_id, rating, sentiment_score FROM ratings WHERE product_id = 42", ("ratings",))
def _(spark, sf):
    return filters.filter_product(D.ratings(spark, sf), 42)


@query("score_present", """
SELECT user_id, product_id, cf_score FROM (SELECT user_id, product_id,
  CASE WHEN interaction_score > 0 THEN interaction_score END AS cf_score FROM behavior)
WHERE user_id = 8 AND cf_score IS NOT NULL""", ("behavior",))
def _(spark, sf):
    scored = interactions(D.events(spark, sf)).select(
        "user_id", "product_id", F.when(F.col("interaction_score") > 0, F.col("interaction_score")).alias("cf_score")
    )
    return filters.score_present(scored, 8, "cf_score")


@query("facet_filter", """
SELECT product_id, category, price_numeric, round(rating, 6) AS rating FROM products
WHERE category = 'ECONOMY' AND coalesce(price_numeric, 0) BETWEEN 925000 AND 975000 AND coalesce(rating, 0) >= 3""",
       ("products",))
def _(spark, sf):
    kept = filters.facet_filter(D.products(spark, sf), "ECONOMY", (925_000.0, 975_000.0), 3.0)
    return kept.select("product_id", "category", "price_numeric", F.round("rating", 6).alias("rating"))


@query("route_topic", """
SELECT page_id, CASE WHEN f LIKE '%product%' THEN 'products' WHEN f LIKE '%review%' THEN 'reviews'
   WHEN f LIKE '%user%' OR f LIKE '%behavior%' THEN 'user_behavior' ELSE 'products' END AS topic
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Products_' WHEN 1 THEN 'reviews_' WHEN 2 THEN 'user_'
   WHEN 3 THEN 'behavior_product_' ELSE 'misc_' END AS g, lower(g) AS f FROM pages)""")
def _(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("Products_", "reviews_", "user_", "behavior_product_", "misc_"))),
                        (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("file:/data/in/"), kind, F.col("page_id").cast("string"), F.lit(".json"))
    return D.load(spark, sf, "pages").select("page_id", route_topic(path).alias("topic"))
