"""Grouped summaries behind the dashboard, product and user pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C


def products_by_category(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.avg("price_numeric").alias("avg_price"),
        F.avg("rating").alias("avg_rating"),
    )


def sentiment_analysis(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.count(F.lit(1)).alias("review_count"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id", "rating").agg(F.count(F.lit(1)).alias("rating_count"))


def user_behavior_analysis(behavior: DataFrame) -> DataFrame:
    return behavior.groupBy("user_id").agg(
        F.sum("action_frequency").alias("total_actions"),
        F.avg("interaction_score").alias("avg_interaction"),
    )


def popular_products(behavior: DataFrame) -> DataFrame:
    return behavior.groupBy("product_id").agg(
        F.sum("action_frequency").alias("total_actions"),
        F.sum("interaction_score").alias("total_interaction"),
    )


def algorithm_comparison(recommendations: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Mean score per user, one column per algorithm; naming them saves a discovery job."""
    return (
        recommendations.groupBy("user_id")
        .pivot("algorithm", list(algorithms))
        .agg(F.avg("recommendation_score"))
    )


def matrix_columns(behavior: DataFrame, limit: int = 2000) -> list:
    """All product ids in order, as columns of a wide matrix; fails where they are more than ``limit``."""
    found = [r[0] for r in behavior.select("product_id").distinct().orderBy("product_id").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} products: use the long form")
    return found


def interaction_matrix(behavior: DataFrame, product_ids: Sequence, average: bool = True) -> DataFrame:
    """User by product table for a bounded product list; missing cells are 0.

    Duplicate cells are averaged, or summed with ``average=False``. The full matrix
    stays in long form everywhere else.
    """
    value = F.avg("interaction_score") if average else F.sum("interaction_score")
    ids = list(product_ids)
    wide = behavior.groupBy("user_id").pivot("product_id", ids).agg(value)
    return wide.na.fill(0.0).select("user_id", *[F.col(str(i)).alias(f"product_{i}") for i in ids])


def kpi_totals(products: DataFrame, behavior: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: products, mean rating, users, reviews."""
    totals = [
        products.agg(F.count(F.lit(1)).alias("total_products"), F.avg("rating").alias("avg_rating")),
        behavior.select("user_id").distinct().agg(F.count("user_id").alias("total_users")),
        reviews.agg(F.count(F.lit(1)).alias("total_reviews")),
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), totals)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def global_rating_histogram(reviews: DataFrame) -> DataFrame:
    """Five rows, zero counts included."""
    counted = reviews.select(C.star_bucket("rating").alias("stars")).where("stars is not null")
    spark = reviews.sparkSession
    buckets = spark.range(1, 6).select(F.col("id").cast("int").alias("stars"))
    return buckets.join(counted.groupBy("stars").agg(F.count(F.lit(1)).alias("n")), "stars", "left").select(
        "stars", F.coalesce("n", F.lit(0)).alias("review_count")
    )


def price_histogram(products: DataFrame, cuts: tuple[float, ...] = C.PRICE_CUTS) -> DataFrame:
    """Products per price band; bands without products are kept with 0."""
    spark = products.sparkSession
    bands = spark.range(0, len(cuts) + 1).select(F.col("id").cast("int").alias("band"))
    counted = products.select(C.price_band("price_numeric", cuts).alias("band")).groupBy("band").agg(
        F.count(F.lit(1)).alias("n")
    )
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("product_count"))


def product_rating_profile(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per product: count and share of each star; zeros where there is no review."""
    stars = range(1, 6)
    counts = reviews.groupBy("product_id").agg(
        *[F.count_if(C.star_bucket("rating") == s).alias(f"n{s}") for s in stars]
    )
    joined = products.select("product_id").join(counts, "product_id", "left").na.fill(0)
    total = sum((F.col(f"n{s}") for s in stars), F.lit(0))
    return joined.withColumn("total", total).select(
        "product_id", "total",
        *[F.col(f"n{s}").alias(f"stars_{s}") for s in stars],
        *[F.when(F.col("total") > 0, F.col(f"n{s}") * 100.0 / F.col("total")).otherwise(0.0).alias(f"pct_{s}")
          for s in stars],
    )


def engagement_summary(behavior: DataFrame) -> DataFrame:
    """Behaviour holds one row per user and product, so a plain count is the distinct count."""
    return behavior.groupBy("user_id").agg(
        F.sum("action_frequency").alias("total_actions"),
        F.avg("interaction_score").alias("avg_interaction"),
        F.count(F.lit(1)).alias("distinct_products"),
    )


def matrix_stats(behavior: DataFrame) -> DataFrame:
    """Users, items, non-zero cells and density of the interaction matrix."""
    pairs = behavior.where(F.col("interaction_score") != 0).select("user_id", "product_id")
    return pairs.agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("product_id").alias("n_items"),
        F.count(F.lit(1)).alias("nnz"),
    ).withColumn("density", F.col("nnz") / (F.col("n_users") * F.col("n_items")))


def recommendation_coverage(recommendations: DataFrame) -> DataFrame:
    """Users reached and mean list length."""
    return recommendations.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("users"), F.avg("n").alias("avg_recommendations")
    )


def distinct_ids(behavior: DataFrame, column: str) -> DataFrame:
    return behavior.select(column).distinct()
