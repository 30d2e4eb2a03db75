"""Orderings, limits, pages and per-group top lists. Every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.functions.filters import filter_product, filter_user

PAGE_SIZE = 12
SHOWN_PAGES = 5


def top_products(products: DataFrame, limit: int = 10) -> DataFrame:
    return products.orderBy(F.desc_nulls_last("popularity_score"), "product_id").limit(limit)


def top_n(df: DataFrame, group: str | Sequence[str], score: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per group.

    Spark plans the row-number filter as a group limit that runs before the shuffle
    too, so a hot group sends at most ``n`` rows per task to its reducer.
    """
    keys = [group] if isinstance(group, str) else list(group)
    order = W.partitionBy(*keys).orderBy(C.ranking_key(score).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def ordered_recommendations(recommendations: DataFrame) -> DataFrame:
    return recommendations.orderBy("user_id", C.ranking_key("recommendation_score").desc(), "product_id")


def ordered_within_partitions(recommendations: DataFrame) -> DataFrame:
    """Per-user order without the global range shuffle: enough for writing files by user."""
    return recommendations.repartition("user_id").sortWithinPartitions(
        "user_id", C.ranking_key("recommendation_score").desc(), "product_id"
    )


def user_recommendations(recommendations: DataFrame, user_id, limit: int = 10) -> DataFrame:
    return (
        filter_user(recommendations, user_id)
        .orderBy(C.ranking_key("recommendation_score").desc(), "product_id")
        .limit(limit)
    )


def product_reviews(reviews: DataFrame, product_id, limit: int = 10) -> DataFrame:
    return (
        filter_product(reviews, product_id)
        .orderBy(F.desc("review_weight"), F.desc("time"), "review_id", "rating")
        .limit(limit)
    )


def user_behavior(behavior: DataFrame, user_id, limit: int = 10) -> DataFrame:
    return filter_user(behavior, user_id).orderBy(F.desc("interaction_score"), "product_id").limit(limit)


def product_details(products: DataFrame, product_id) -> DataFrame:
    return filter_product(products, product_id).limit(1)


LISTING_ORDERS = ("popularity", "price_asc", "price_desc", "rating")


def _listing_order(sort: str) -> list[Column]:
    def zero(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0.0))

    orders = {
        "popularity": zero("popularity_score").desc(),
        "price_asc": zero("price_numeric").asc(),
        "price_desc": zero("price_numeric").desc(),
        "rating": zero("rating").desc(),
    }
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}, expected one of {LISTING_ORDERS}")
    return [orders[sort], F.col("product_id").asc()]


def list_products(products: DataFrame, sort: str = "popularity") -> DataFrame:
    return products.orderBy(*_listing_order(sort))


def paginate(products: DataFrame, page: int, sort: str = "popularity", size: int = PAGE_SIZE) -> DataFrame:
    """One page of the listing: a bounded top-k with an offset, never a global row number."""
    return list_products(products, sort).offset((page - 1) * size).limit(size)


def page_count(products: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    total = F.count(F.lit(1))
    pages = F.ceil(total / size)
    return products.agg(
        total.alias("items"), pages.alias("pages"), F.least(pages, F.lit(SHOWN_PAGES)).alias("pages_shown")
    )


def point_lookup(view: DataFrame, key: str, value) -> DataFrame:
    """Row of a serving view by key, or none."""
    return view.where(F.col(key) == F.lit(value)).limit(1)
