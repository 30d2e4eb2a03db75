"""Joins, aggregations, set and keyed-table operations."""

from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise.operators import aggregates as A
from shelfwise.operators import interactions as I
from shelfwise.operators import snapshots as S
from shelfwise.operators.evaluation import latency_summary
from shelfwise.operators.ids import attach_indexes, deindex, index_ids
from shelfwise.registry.core import define, query
from shelfwise.registry.scalars import BAND_SQL, CUTS
from shelfwise.session import scratch_path
from shelfwise.sources.keyed import KeyedTable
from shelfwise.sources.tables import query_view, register_views, run_sql


def behavior(spark, sf):
    return I.interactions(D.events(spark, sf))


@query("frequency_score_join", "SELECT * FROM behavior", ("behavior",))
def _(spark, sf):
    return behavior(spark, sf)


@query("action_frequency", "SELECT user_id, product_id, action_frequency FROM behavior", ("behavior",))
def _(spark, sf):
    return I.action_frequency(D.events(spark, sf))


@query("interaction_score", "SELECT user_id, product_id, interaction_score FROM behavior", ("behavior",))
def _(spark, sf):
    return I.interaction_score(D.events(spark, sf))


@query("behavior_product_join", """
SELECT user_id, product_id, action_frequency, interaction_score, name, price, round(rating, 6) AS rating,
       round(popularity_score, 6) AS popularity_score
FROM behavior JOIN products USING (product_id)""", ("behavior", "products"))
def _(spark, sf):
    joined = I.with_products(behavior(spark, sf), D.products(spark, sf))
    return joined.withColumns({c: F.round(c, 6) for c in ("rating", "popularity_score")})


def _indexed(spark, sf):
    b = behavior(spark, sf)
    users, items = index_ids(b, "user_id", "user_index"), index_ids(b, "product_id", "item_index")
    return attach_indexes(b, users, items), users, items


@query("index_ids_join", """
SELECT count(*) AS pairs, count(DISTINCT user_id) AS users, CAST(0 AS INTEGER) AS min_user_index,
       CAST(count(DISTINCT user_id) - 1 AS INTEGER) AS max_user_index,
       CAST(count(DISTINCT product_id) - 1 AS INTEGER) AS max_item_index, sum(interaction_score) AS total
FROM behavior""", ("behavior",))
def _(spark, sf):
    joined, _, _ = _indexed(spark, sf)
    return joined.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("user_index").alias("users"),
        F.min("user_index").alias("min_user_index"), F.max("user_index").alias("max_user_index"),
        F.max("item_index").alias("max_item_index"), F.sum("interaction_score").alias("total"),
    )


@query("deindex_join", "SELECT user_id, product_id, interaction_score FROM behavior", ("behavior",))
def _(spark, sf):
    joined, users, items = _indexed(spark, sf)
    return deindex(joined.select("user_index", "item_index", "interaction_score"), users, items).select(
        "user_id", "product_id", "interaction_score"
    )


@query("index_ids", """
SELECT count(*) AS n, min(user_index) AS lowest, max(user_index) AS highest,
       count(DISTINCT user_index) AS distinct_indexes
FROM (SELECT CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS user_index
      FROM (SELECT DISTINCT user_id FROM events))""")
def _(spark, sf):
    return index_ids(D.events(spark, sf), "user_id", "user_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("user_index").alias("lowest"), F.max("user_index").alias("highest"),
        F.count_distinct("user_index").alias("distinct_indexes"),
    )


@query("enrich_recommendations", """
SELECT user_id, product_id, interaction_score, name, price, round(rating, 6) AS rating,
       round(popularity_score, 6) AS popularity_score
FROM behavior JOIN products USING (product_id)""", ("behavior", "products"))
def _(spark, sf):
    recs = behavior(spark, sf).drop("action_frequency")
    return I.enrich(recs, D.products(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("rating", "popularity_score")}
    )


# Recommended ids that the catalogue partly lacks: products of the behaviour, and order numbers beside them.
define("recommended", """
SELECT user_id, product_id, interaction_score FROM behavior
UNION ALL SELECT o_custkey, o_orderkey, CAST(1.0 AS DOUBLE) FROM orders""", ("behavior",))


def recommended(spark, sf):
    orders = D.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("product_id"), F.lit(1.0).alias("interaction_score"))
    return behavior(spark, sf).drop("action_frequency").unionByName(orders)


@query("enrich_with_defaults", """
SELECT b.user_id, b.product_id, b.interaction_score,
       CASE WHEN p.product_id IS NULL THEN 'Product ' || CAST(b.product_id AS VARCHAR) ELSE p.name END AS name,
       CASE WHEN p.product_id IS NULL THEN 'Unknown' ELSE p.price END AS price,
       round(CASE WHEN p.product_id IS NULL THEN 0.0 ELSE p.rating END, 6) AS rating,
       round(CASE WHEN p.product_id IS NULL THEN 1.0 ELSE p.popularity_score END, 6) AS popularity_score
FROM recommended b LEFT JOIN products p ON b.product_id = p.product_id""", ("recommended", "products"))
def _(spark, sf):
    return I.enrich_with_defaults(recommended(spark, sf), D.products(spark, sf)).withColumns(
        {c: F.round(c, 6) for c in ("rating", "popularity_score")}
    )


@query("exclude_seen", """
SELECT user_id, product_id FROM behavior b WHERE NOT EXISTS
  (SELECT 1 FROM behavior s WHERE s.user_id = b.user_id AND s.product_id = b.product_id AND s.interaction_score > 0)""",
       ("behavior",))
def _(spark, sf):
    b = behavior(spark, sf)
    return I.exclude_seen(b.select(*I.PAIR), b.where("interaction_score > 0"))


@query("known_products_only", """
SELECT * FROM recommended WHERE product_id IN (SELECT product_id FROM products)""", ("recommended", "products"))
def _(spark, sf):
    return I.known_products_only(recommended(spark, sf), D.products(spark, sf))


@query("behavior_detail_join", """
SELECT event_id, user_id, product_id, action, p_name AS name FROM ev LEFT JOIN part ON product_id = p_partkey
WHERE user_id = 8""", ("ev",))
def _(spark, sf):
    mine = D.events(spark, sf).where("user_id = 8").select("event_id", "user_id", "product_id", "action")
    return I.user_actions(mine, D.catalog_text(spark, sf))


@query("products_by_category", """
SELECT category, count(*) AS product_count, round(avg(price_numeric), 4) AS avg_price,
       round(avg(rating), 6) AS avg_rating FROM products GROUP BY category""", ("products",))
def _(spark, sf):
    return A.products_by_category(D.products(spark, sf)).withColumns(
        {"avg_price": F.round("avg_price", 4), "avg_rating": F.round("avg_rating", 6)}
    )


@query("sentiment_analysis", """
SELECT product_id, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) AS review_count
FROM ratings GROUP BY product_id""", ("ratings",))
def _(spark, sf):
    return A.sentiment_analysis(D.ratings(spark, sf)).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("rating_distribution", """
SELECT product_id, rating, count(*) AS rating_count FROM ratings GROUP BY product_id, rating""", ("ratings",))
def _(spark, sf):
    return A.rating_distribution(D.ratings(spark, sf))


@query("user_behavior_analysis", """
SELECT user_id, CAST(sum(action_frequency) AS BIGINT) AS total_actions,
       round(avg(interaction_score), 6) AS avg_interaction FROM behavior GROUP BY user_id""", ("behavior",))
def _(spark, sf):
    return A.user_behavior_analysis(behavior(spark, sf)).withColumn("avg_interaction", F.round("avg_interaction", 6))


@query("popular_products", """
SELECT product_id, CAST(sum(action_frequency) AS BIGINT) AS total_actions,
       sum(interaction_score) AS total_interaction FROM behavior GROUP BY product_id""", ("behavior",))
def _(spark, sf):
    return A.popular_products(behavior(spark, sf)).orderBy(F.desc("total_interaction"), "product_id")


@query("interaction_matrix", "SELECT user_id, " + ", ".join(
    f"coalesce(avg(CASE WHEN product_id = {i} THEN interaction_score END), 0.0) AS product_{i}" for i in range(100)
) + " FROM behavior GROUP BY user_id", ("behavior",))
def _(spark, sf):
    rows = behavior(spark, sf)
    return A.interaction_matrix(rows, A.matrix_columns(rows))


@query("kpi_totals", """
SELECT (SELECT count(*) FROM products) AS total_products,
       (SELECT round(avg(rating), 6) FROM products) AS avg_rating,
       (SELECT count(DISTINCT user_id) FROM events) AS total_users,
       (SELECT count(*) FROM lineitem) AS total_reviews""", ("products",))
def _(spark, sf):
    kpi = A.kpi_totals(D.products(spark, sf), D.events(spark, sf), D.ratings(spark, sf))
    return kpi.withColumn("avg_rating", F.round("avg_rating", 6))


@query("global_rating_histogram", """
SELECT CAST(s AS INTEGER) AS stars, (SELECT count(*) FROM ratings WHERE rating = s) AS review_count
FROM range(1, 6) t(s)""", ("ratings",))
def _(spark, sf):
    return A.global_rating_histogram(D.ratings(spark, sf))


@query("price_histogram", f"""
WITH bands AS (SELECT {BAND_SQL} AS band FROM (SELECT round(p_retailprice * 1000) AS price_numeric FROM part))
SELECT CAST(b AS INTEGER) AS band, (SELECT count(*) FROM bands WHERE band = b) AS product_count
FROM range(0, 4) t(b)""")
def _(spark, sf):
    return A.price_histogram(D.products(spark, sf), CUTS)


@query("product_rating_profile", "SELECT p_partkey AS product_id, CAST(count(rating) AS BIGINT) AS total, " + ", ".join(
    f"CAST(count(CASE WHEN rating = {s} THEN 1 END) AS BIGINT) AS stars_{s}" for s in range(1, 6)
) + ", " + ", ".join(
    f"round(CASE WHEN count(rating) > 0 THEN count(CASE WHEN rating = {s} THEN 1 END) * 100.0::DOUBLE / count(rating) "
    f"ELSE 0.0 END, 6) AS pct_{s}" for s in range(1, 6)
) + " FROM part LEFT JOIN ratings ON product_id = p_partkey GROUP BY p_partkey", ("ratings",))
def _(spark, sf):
    profile = A.product_rating_profile(D.catalog_text(spark, sf), D.ratings(spark, sf))
    return profile.withColumns({f"pct_{s}": F.round(f"pct_{s}", 6) for s in range(1, 6)})


@query("engagement_summary", """
SELECT user_id, CAST(sum(action_frequency) AS BIGINT) AS total_actions,
       round(avg(interaction_score), 6) AS avg_interaction, count(DISTINCT product_id) AS distinct_products
FROM behavior GROUP BY user_id""", ("behavior",))
def _(spark, sf):
    return A.engagement_summary(behavior(spark, sf)).withColumn("avg_interaction", F.round("avg_interaction", 6))


@query("latency_summary", """
SELECT event_type AS endpoint, count(*) AS requests,
       round(count(CASE WHEN event_id % 10 <> 0 THEN 1 END) / count(*), 6) AS success_rate,
       round(avg(CASE WHEN event_id % 10 <> 0 THEN value END), 6) AS avg_time,
       min(CASE WHEN event_id % 10 <> 0 THEN value END) AS min_time,
       max(CASE WHEN event_id % 10 <> 0 THEN value END) AS max_time,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS requests_per_second,
       round(quantile_cont(CASE WHEN event_id % 10 <> 0 THEN value END, 0.95), 6) AS p95_time
FROM events GROUP BY event_type""")
def _(spark, sf):
    summary = latency_summary(D.request_log(spark, sf))
    return summary.withColumns({
        **{c: F.round(c, 6) for c in ("success_rate", "avg_time", "p95_time")},
        "requests_per_second": F.round("requests_per_second", 9),
    })


@query("matrix_stats", """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_items, count(*) AS nnz,
       round(count(*) / (count(DISTINCT user_id) * count(DISTINCT product_id)), 9) AS density
FROM behavior WHERE interaction_score <> 0""", ("behavior",))
def _(spark, sf):
    return A.matrix_stats(behavior(spark, sf)).withColumn("density", F.round("density", 9))


@query("recommendation_coverage", """
SELECT count(*) AS users, round(avg(n), 6) AS avg_recommendations
FROM (SELECT user_id, count(*) AS n FROM behavior WHERE interaction_score > 0 GROUP BY user_id)""", ("behavior",))
def _(spark, sf):
    listed = behavior(spark, sf).where("interaction_score > 0")
    return A.recommendation_coverage(listed).withColumn("avg_recommendations", F.round("avg_recommendations", 6))


@query("distinct_ids", "SELECT DISTINCT product_id FROM ev", ("ev",))
def _(spark, sf):
    return A.distinct_ids(D.events(spark, sf), "product_id")


# Batch and real-time halves of the events, split at a fixed day.
CUT_DAY = "2024-01-21"
define("newest_event", """
SELECT user_id, product_id, event_id, action, ts FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, event_id DESC) = 1""", ("ev",))
EVENT_COLUMNS = ("user_id", "product_id", "event_id", "action", "ts")


def _halves(spark, sf):
    rows = D.events(spark, sf).select(*EVENT_COLUMNS)
    cut = F.to_timestamp_ntz(F.lit(f"{CUT_DAY} 00:00:00"))
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)



def _version():
    return [F.col("ts"), F.col("event_id")]


@query("latest_snapshot", "SELECT * FROM newest_event", ("newest_event",))
def _(spark, sf):
    return S.latest_per_key(D.events(spark, sf).select(*EVENT_COLUMNS), I.PAIR, _version())


@query("latest_run", f"""
SELECT event_id, action, CAST(ts AS DATE) AS run_ts FROM ev
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM ev)""", ("ev",))
def _(spark, sf):
    runs = D.events(spark, sf).select("event_id", "action", F.col("ts").cast("date").alias("run_ts"))
    return S.latest_run(runs)


@query("merged_view", "SELECT * FROM newest_event", ("newest_event",))
def _(spark, sf):
    batch, realtime = _halves(spark, sf)
    return S.merged_view(batch, realtime, I.PAIR, _version())


@query("speed_layer_accumulate", "SELECT user_id, product_id, event_id, action, ts FROM ev", ("ev",))
def _(spark, sf):
    batch, realtime = _halves(spark, sf)
    return S.accumulate([batch, realtime, realtime], ["event_id"])


@query("upsert_document", """
SELECT product_id AS doc_id, event_id, action, ts FROM ev
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, event_id DESC) = 1""", ("ev",))
def _(spark, sf):
    table, changes = (h.select(F.col("product_id").alias("doc_id"), "event_id", "action", "ts")
                      for h in _halves(spark, sf))
    documents = KeyedTable(spark, scratch_path(spark, "keyed"), "doc_id", table.schema["doc_id"].dataType, _version(), buckets=8)
    documents.create(table)
    documents.upsert(changes)
    return documents.read()


@query("get_document", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def _(spark, sf):
    docs = D.load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return S.get_document(docs, "doc_id", 42)


@query("delete_document", """
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, sf):
    docs = D.load(spark, sf, "documents").select("doc_id", "lang", "source")
    documents = KeyedTable(spark, scratch_path(spark, "keyed"), "doc_id", docs.schema["doc_id"].dataType, [F.col("source")], buckets=8)
    documents.create(docs)
    documents.delete(D.load(spark, sf, "labels").where("toxic = 1"))
    return documents.read()


@query("run_sql", """
SELECT category, count(*) AS n, round(max(popularity_score), 6) AS best FROM products
WHERE rating >= 3.0 GROUP BY category""", ("products",))
def _(spark, sf):
    register_views({"products": D.products(spark, sf)})
    return run_sql(
        spark,
        """SELECT category, count(*) AS n, round(max(popularity_score), 6) AS best
           FROM products WHERE rating >= :least GROUP BY category""",
        {"least": 3.0},
    )


@query("query_view", """
SELECT product_id, CAST(sum(action_frequency) AS BIGINT) AS total_actions,
       sum(interaction_score) AS total_interaction FROM behavior GROUP BY product_id
HAVING sum(interaction_score) >= 100""", ("behavior",))
def _(spark, sf):
    view = A.popular_products(behavior(spark, sf))
    return query_view(view, lambda v: v.where("total_interaction >= 100"))
