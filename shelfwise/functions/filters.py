"""Row predicates, all pushed down to the scan where the source allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_user(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") == F.lit(user_id))


def filter_product(df: DataFrame, product_id) -> DataFrame:
    return df.where(F.col("product_id") == F.lit(product_id))


def score_present(df: DataFrame, user_id, score: str) -> DataFrame:
    return filter_user(df, user_id).where(F.col(score).isNotNull())


def facet_filter(
    products: DataFrame,
    category: str | None = None,
    price_range: tuple[float, float | None] | None = None,
    min_rating: float | None = None,
) -> DataFrame:
    """Empty facets do not filter; both ends of the price range are inclusive."""
    kept = products
    if category:
        kept = kept.where(F.col("category") == category)
    if price_range:
        low, high = price_range
        price = F.coalesce(F.col("price_numeric"), F.lit(0.0))
        kept = kept.where(price >= low)
        if high is not None:
            kept = kept.where(price <= high)
    if min_rating:
        kept = kept.where(F.coalesce(F.col("rating"), F.lit(0.0)) >= min_rating)
    return kept
