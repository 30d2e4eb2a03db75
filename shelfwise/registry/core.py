"""How a query is registered, and the table definitions the checking SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)``; ``sql`` is its twin over the same tables, ``uses`` shared definitions."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_definitions(sql, uses)
        return fn

    return register


DEFINITIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    DEFINITIONS[name] = (uses, sql.strip())


def with_definitions(body: str, uses: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in DEFINITIONS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({DEFINITIONS[n][1]})" for n in ordered)
    # A body that starts with a comma goes on with definitions of its own.
    return f"WITH {ctes}\n{body.strip()}"


define("ev", """
SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
       CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'add_to_cart'
                       WHEN 'purchase' THEN 'purchase' ELSE 'other' END AS action,
       ts, value
FROM events""")

define("weighted", """
SELECT *, CASE action WHEN 'purchase' THEN 5.0::DOUBLE WHEN 'add_to_cart' THEN 3.0::DOUBLE
                      WHEN 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS action_weight
FROM ev""", ("ev",))

define("behavior", """
SELECT user_id, product_id, count(*) AS action_frequency, sum(action_weight) AS interaction_score
FROM weighted GROUP BY user_id, product_id""", ("weighted",))

define("sales", """
SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS units,
       avg(1 + (l_linenumber + CAST(l_quantity AS INTEGER)) % 5) AS rating,
       min(l_suppkey) AS s_suppkey
FROM lineitem GROUP BY l_partkey""")

define("raw_products", """
SELECT p_partkey AS product_id, p_name AS name,
       replace(format('{:,}', CAST(round(p_retailprice * 1000) AS BIGINT)), ',', '.') || 'đ' AS price,
       rating,
       CASE WHEN units >= 1000
            THEN CAST(units // 1000 AS VARCHAR) || 'k' || CAST((units % 1000) // 100 AS VARCHAR)
            ELSE CAST(units AS VARCHAR) END AS sold,
       n_name AS location,
       'https://shop.example/' || replace(p_name, ' ', '-') || '-i.' || CAST(p_size AS VARCHAR) || '.'
         || CAST(p_partkey AS VARCHAR) || '?sp=1' AS url,
       p_type AS category, replace(p_brand, '#', '') AS brand, CAST(NULL AS VARCHAR) AS description
FROM part LEFT JOIN sales ON p_partkey = l_partkey
LEFT JOIN supplier USING (s_suppkey) LEFT JOIN nation ON s_nationkey = n_nationkey""", ("sales",))

define("products", """
SELECT *, rating * sold_numeric / 1000 AS popularity_score
FROM (SELECT *,
  TRY_CAST(regexp_replace(price, '[^0-9]', '', 'g') AS DOUBLE) AS price_numeric,
  CASE WHEN regexp_matches(sold, '[0-9]+k[0-9]+$')
       THEN round(TRY_CAST(replace(sold, 'k', '.') AS DOUBLE) * 1000, 3)
       ELSE TRY_CAST(regexp_replace(sold, '[^0-9]', '', 'g') AS DOUBLE) END AS sold_numeric
  FROM raw_products)""", ("raw_products",))

define("ratings", """
SELECT l_partkey AS product_id, 1 + (l_linenumber + CAST(l_quantity AS INTEGER)) % 5 AS rating,
       CASE WHEN 1 + (l_linenumber + CAST(l_quantity AS INTEGER)) % 5 >= 4 THEN 1.0::DOUBLE
            WHEN 1 + (l_linenumber + CAST(l_quantity AS INTEGER)) % 5 = 3 THEN 0.0::DOUBLE
            ELSE -1.0::DOUBLE END AS sentiment_score
FROM lineitem""")

define("sizes", """
SELECT doc_id, CAST(length(text) AS INTEGER) AS comment_length,
       CASE WHEN length(text) > 100 THEN 2.0::DOUBLE WHEN length(text) > 50 THEN 1.5::DOUBLE
            ELSE 1.0::DOUBLE END AS review_weight
FROM documents""")

define("reviews", """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
         AS review_id,
       l_partkey AS product_id, CAST(o_custkey AS VARCHAR) AS username,
       1 + (l_linenumber + CAST(l_quantity AS INTEGER)) % 5 AS rating, l_shipdate AS time,
       comment_length, review_weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN sizes ON sizes.doc_id = l_orderkey % (SELECT count(*) FROM documents)""", ("sizes",))

define("raw_reviews", """
SELECT reviews.*, text AS comment FROM reviews JOIN documents
ON doc_id = CAST(split_part(review_id, '-', 1) AS BIGINT) % (SELECT count(*) FROM documents)""", ("reviews",))

define("baseline", """
SELECT user_id, product_id, name, price, rating, popularity_score, interaction_score,
       interaction_score * popularity_score AS recommendation_score
FROM behavior JOIN products USING (product_id)""", ("behavior", "products"))

define("purchases", """
SELECT o_custkey AS user_id, l_partkey AS product_id, sum(l_quantity) AS interaction_score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
