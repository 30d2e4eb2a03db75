"""Top lists, lookups, pages and serving views."""

from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise.operators import interactions as I
from shelfwise.operators import ranking as R
from shelfwise.operators.ids import ordinal_ids
from shelfwise.operators.search import term_lookup
from shelfwise.plans import views as V
from shelfwise.registry.core import query
from shelfwise.registry.tables import behavior
from shelfwise.registry.views import view

SHOWN = ("product_id", "name", "category", "price", "price_numeric", "sold_numeric")
SHOWN_SQL = ", ".join(SHOWN) + ", round(rating, 6) AS rating, round(popularity_score, 6) AS popularity_score"


def shown(df):
    return df.select(*SHOWN, F.round("rating", 6).alias("rating"),
                     F.round("popularity_score", 6).alias("popularity_score"))


def baseline(spark, sf):
    return I.popularity_baseline(behavior(spark, sf), D.products(spark, sf))


RECS_SQL = """user_id, product_id, name, price, round(rating, 6) AS rating, round(popularity_score, 6) AS
 popularity_score, interaction_score, round(recommendation_score, 6) AS recommendation_score"""


def rounded_recs(df):
    return df.withColumns({c: F.round(c, 6) for c in ("rating", "popularity_score", "recommendation_score")})


@query("top_products", f"""
SELECT {SHOWN_SQL} FROM products p ORDER BY p.popularity_score DESC NULLS LAST, product_id LIMIT 10""", ("products",))
def _(spark, sf):
    return shown(R.top_products(D.products(spark, sf)))


@query("top_products_view", f"""
SELECT {SHOWN_SQL} FROM products p ORDER BY p.popularity_score DESC NULLS LAST, product_id LIMIT 100""", ("products",))
def _(spark, sf):
    return shown(V.product_views(D.products(spark, sf))["top_products"])


@query("user_recommendations", f"""
SELECT {RECS_SQL} FROM baseline b WHERE user_id = 8
ORDER BY round(b.recommendation_score, 9) DESC, product_id LIMIT 10""", ("baseline",))
def _(spark, sf):
    stored = view(spark, sf, "recommendations", "user_id", baseline, [F.desc("recommendation_score")])
    return rounded_recs(R.user_recommendations(stored.of(8).drop("action_frequency"), 8))


@query("product_reviews", """
SELECT review_id, username, rating, time, comment_length, review_weight FROM reviews WHERE product_id = 42
ORDER BY review_weight DESC, time DESC, review_id, rating LIMIT 10""", ("reviews",))
def _(spark, sf):
    stored = view(spark, sf, "reviews", "product_id", D.reviews, [F.desc("review_weight")])
    return R.product_reviews(stored.of(42), 42).select(
        "review_id", "username", "rating", "time", "comment_length", "review_weight"
    )


@query("user_behavior", """
SELECT * FROM behavior WHERE user_id = 8 ORDER BY interaction_score DESC, product_id LIMIT 10""", ("behavior",))
def _(spark, sf):
    return R.user_behavior(view(spark, sf, "behavior", "user_id", behavior).of(8), 8)


@query("product_details", f"SELECT {SHOWN_SQL} FROM products WHERE product_id = 42", ("products",))
def _(spark, sf):
    return shown(R.product_details(view(spark, sf, "products", "product_id", D.products).of(42), 42))


@query("list_products", f"""
SELECT {SHOWN_SQL}, row_number() OVER (ORDER BY coalesce(price_numeric, 0) DESC, product_id) AS place
FROM products""", ("products",))
def _(spark, sf):
    listed = R.list_products(D.products(spark, sf), "price_desc")
    placed = ordinal_ids(shown(listed).withColumn("_desc", -F.coalesce("price_numeric", F.lit(0.0))),
                         ["_desc", "product_id"], "place")
    return placed.drop("_desc").withColumn("place", F.col("place") + 1)


@query("paginate", f"""
SELECT {SHOWN_SQL} FROM products p ORDER BY coalesce(p.rating, 0) DESC, product_id LIMIT 12 OFFSET 24""",
       ("products",))
def _(spark, sf):
    return shown(R.paginate(D.products(spark, sf), 3, "rating"))


@query("page_count", """
SELECT count(*) AS items, CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages,
       least(CAST(ceil(count(*) / 12.0) AS BIGINT), 5) AS pages_shown FROM part""")
def _(spark, sf):
    return R.page_count(D.catalog_text(spark, sf))


@query("ordered_recommendations", f"SELECT {RECS_SQL} FROM baseline", ("baseline",))
def _(spark, sf):
    return rounded_recs(R.ordered_recommendations(baseline(spark, sf).drop("action_frequency")))


@query("popularity_baseline", f"SELECT {RECS_SQL}, action_frequency FROM baseline JOIN (SELECT user_id, product_id, "
       "action_frequency FROM behavior) USING (user_id, product_id)", ("baseline",))
def _(spark, sf):
    return rounded_recs(baseline(spark, sf))


@query("top_n_per_user", f"""
SELECT {RECS_SQL}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY round(recommendation_score, 9) DESC, product_id) AS rank FROM baseline) WHERE rank <= 5""", ("baseline",))
def _(spark, sf):
    recs = baseline(spark, sf).drop("action_frequency")
    return rounded_recs(R.top_n(recs, "user_id", "recommendation_score", "product_id", 5))


@query("sentiment_of", """
SELECT product_id, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) AS review_count
FROM ratings WHERE product_id = 42 GROUP BY product_id""", ("ratings",))
def _(spark, sf):
    view = V.review_views(D.ratings(spark, sf))["sentiment_analysis"]
    return R.point_lookup(view, "product_id", 42).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("behavior_of", """
SELECT user_id, CAST(sum(action_frequency) AS BIGINT) AS total_actions,
       round(avg(interaction_score), 6) AS avg_interaction FROM behavior WHERE user_id = 8 GROUP BY user_id""",
       ("behavior",))
def _(spark, sf):
    view = V.behavior_views(behavior(spark, sf))["user_behavior_analysis"]
    return R.point_lookup(view, "user_id", 8).withColumn("avg_interaction", F.round("avg_interaction", 6))


@query("term_lookup", """
SELECT event_id, user_id, product_id, ts FROM ev WHERE action = 'purchase' ORDER BY ts DESC, event_id LIMIT 10""",
       ("ev",))
def _(spark, sf):
    rows = D.events(spark, sf).select("event_id", "user_id", "product_id", "ts", "action")
    return term_lookup(rows, "action", "purchase", [F.desc("ts"), F.asc("event_id")]).drop("action")

