"""From raw behaviour events to scored user-product interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.operators.skew import join_unique

PAIR = ["user_id", "product_id"]


def interactions(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Frequency and weighted score per user and product: one scan, one shuffle.

    Both measures combine map-side, so a hot user or product reaches the shuffle
    already reduced to one row per pair and task.
    """
    return events.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("action_frequency"),
        F.sum(C.action_weight("action", weights)).alias("interaction_score"),
    )


def action_frequency(events: DataFrame) -> DataFrame:
    return events.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("action_frequency"))


def interaction_score(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return events.groupBy(*PAIR).agg(F.sum(C.action_weight("action", weights)).alias("interaction_score"))


def with_products(behavior: DataFrame, products: DataFrame) -> DataFrame:
    """Inner join with the product columns a recommendation shows; hot products are split.

    The catalogue may itself be a join on the product, which keeps AQE from splitting.
    """
    shown = products.select("product_id", "name", "price", "rating", "popularity_score")
    return join_unique(behavior, shown, "product_id")


def popularity_baseline(behavior: DataFrame, products: DataFrame) -> DataFrame:
    return with_products(behavior, products).withColumn(
        "recommendation_score", C.recommendation_score("interaction_score", "popularity_score")
    )


def user_actions(events: DataFrame, products: DataFrame) -> DataFrame:
    """Each behaviour with the product's name; unknown products keep a null name."""
    return events.join(products.select("product_id", "name"), "product_id", "left")


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    return candidates.join(seen.select(*PAIR), PAIR, "left_anti")


def known_products_only(recommendations: DataFrame, products: DataFrame) -> DataFrame:
    return recommendations.join(products.select("product_id"), "product_id", "left_semi")


def enrich_with_defaults(recommendations: DataFrame, products: DataFrame) -> DataFrame:
    """Attach product columns; an unknown product gets placeholder values."""
    known = products.select(
        "product_id", F.lit(True).alias("_known"),
        "name", "price", "rating", "popularity_score",
    )

    def default(column: str, value):
        return F.when(F.col("_known"), F.col(column)).otherwise(value).alias(column)

    return recommendations.join(known, "product_id", "left").select(
        *recommendations.columns,
        default("name", F.concat(F.lit("Product "), F.col("product_id").cast("string"))),
        default("price", F.lit("Unknown")),
        default("rating", F.lit(0.0)),
        default("popularity_score", F.lit(1.0)),
    )


def enrich(recommendations: DataFrame, products: DataFrame) -> DataFrame:
    """Attach product columns, dropping recommendations of unknown products."""
    return with_products(recommendations, products)
