"""Canonical tables derived from the star-schema parquet files.

Everything is a lazy plan. Joins that a query does not need are not built, so a
query over ratings never touches orders or review texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import columns as C


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", "view")
        .when(kind == "click", "add_to_cart")
        .when(kind == "purchase", "purchase")
        .otherwise("other")
    )
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        action.alias("action"), "ts", "value",
    )


def _stars():
    return 1 + (F.col("l_linenumber") + F.col("l_quantity").cast("int")) % 5


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as collected: prices and sold counts are still display text."""
    sales = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("units"),
            F.avg(_stars()).alias("rating"),
            F.min("l_suppkey").alias("s_suppkey"),
        )
    )
    place = (
        load(spark, sf_dir, "supplier")
        .join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("location"))
    )
    units = F.col("units")
    compact = F.when(
        units >= 1000,
        F.concat(F.floor(units / 1000).cast("string"), F.lit("k"), F.floor(units % 1000 / 100).cast("string")),
    ).otherwise(units.cast("string"))
    dong = F.round(F.col("p_retailprice") * 1000).cast("bigint")
    return (
        load(spark, sf_dir, "part")
        .join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(place, "s_suppkey", "left")
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.concat(F.translate(F.format_number(dong, 0), ",", "."), F.lit("đ")).alias("price"),
            "rating",
            compact.alias("sold"),
            "location",
            F.concat(
                F.lit("https://shop.example/"), F.translate("p_name", " ", "-"), F.lit("-i."),
                F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit("?sp=1"),
            ).alias("url"),
            F.col("p_type").alias("category"),
            F.regexp_replace("p_brand", "#", "").alias("brand"),
            F.lit(None).cast("string").alias("description"),
        )
    )


def enrich_products(products: DataFrame) -> DataFrame:
    """Add the numeric price, numeric sold count and popularity."""
    return products.withColumns(
        {"price_numeric": C.price_numeric("price"), "sold_numeric": C.sold_numeric("sold")}
    ).withColumn("popularity_score", C.popularity_score("rating", "sold_numeric"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_products(raw_products(spark, sf_dir))


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that describe a product in words: no sales scan needed."""
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.regexp_replace("p_brand", "#", "").alias("brand"),
        F.col("p_type").alias("category"),
        F.lit(None).cast("string").alias("description"),
    )


def enrich_reviews(reviews: DataFrame) -> DataFrame:
    """Add sentiment, comment length and weight."""
    return (
        reviews.withColumn("sentiment_score", C.sentiment_score("rating"))
        .withColumn("comment_length", C.comment_length("comment"))
        .withColumn("review_weight", C.review_weight("comment_length"))
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review stars with sentiment, one scan and no join."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), _stars().alias("rating")
    ).withColumn("sentiment_score", C.sentiment_score("rating"))


def comment_sizes(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """Weight per comment text, computed before any join; the texts themselves only where they are asked for."""
    return (
        load(spark, sf_dir, "documents")
        .select("doc_id", C.comment_length("text").alias("comment_length"), *([F.col("text").alias("comment")] if texts else []))
        .withColumn("review_weight", C.review_weight("comment_length"))
    )


def reviews(spark: SparkSession, sf_dir: str, texts: bool = False, longer_than: int | None = None, up_to: int | None = None) -> DataFrame:
    """Reviews with author, time, sentiment and the weight of their comment, or also its text.

    With texts the join is a merge: rows with the same text come out next to each other, for writers that compress.
    ``longer_than`` and ``up_to`` leave the reviews with texts of more or of at most so many bytes.
    """
    total = load(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    comments = comment_sizes(spark, sf_dir, texts)
    # Text ids are made after the joins: numbers are smaller to shuffle.
    sold = (
        load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", _stars().alias("rating"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("doc_id", F.col("l_orderkey") % total)
    )
    size = F.coalesce(F.octet_length("comment"), F.lit(0))
    if up_to is not None:
        comments = comments.where(size <= up_to)
    if longer_than is not None:
        comments = comments.where(size > longer_than)
        # Their ids are few beside the texts: only reviews of these go through the shuffle.
        sold = sold.join(F.broadcast(comments.select("doc_id")), "doc_id", "left_semi")
    return (
        sold.join(comments.hint("merge") if texts else comments, "doc_id")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("review_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("o_custkey").cast("string").alias("username"),
            "rating",
            F.col("l_shipdate").alias("time"),
            C.sentiment_score("rating").alias("sentiment_score"),
            *[c for c in comments.columns if c != "doc_id"],
        )
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger interaction graph: customer, product, quantity bought."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"))
        .agg(F.sum("l_quantity").alias("interaction_score"))
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("endpoint"),
        (F.col("event_id") % 10 != 0).alias("success"),
        F.col("value").alias("response_time"),
        "ts",
    )
