"""The serving views, as plans over the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.operators import aggregates as A
from shelfwise.operators import ranking as R

TOP_PRODUCTS = 100


def product_views(products: DataFrame) -> dict[str, DataFrame]:
    return {
        "top_products": R.top_products(products, TOP_PRODUCTS),
        "products_by_category": A.products_by_category(products),
    }


def review_views(reviews: DataFrame) -> dict[str, DataFrame]:
    return {
        "sentiment_analysis": A.sentiment_analysis(reviews),
        "rating_distribution": A.rating_distribution(reviews),
    }


def behavior_views(behavior: DataFrame) -> dict[str, DataFrame]:
    return {
        "user_behavior_analysis": A.user_behavior_analysis(behavior),
        "popular_products": A.popular_products(behavior),
    }


def recommendation_views(recommendations: DataFrame, algorithms: tuple[str, ...]) -> dict[str, DataFrame]:
    return {
        "user_recommendations": R.ordered_within_partitions(recommendations),
        "algorithm_comparison": A.algorithm_comparison(recommendations, algorithms),
    }


def serving_views(
    products: DataFrame, reviews: DataFrame, behavior: DataFrame, recommendations: DataFrame,
    algorithms: tuple[str, ...],
) -> dict[str, DataFrame]:
    return {
        **product_views(products), **review_views(reviews), **behavior_views(behavior),
        **recommendation_views(recommendations, algorithms),
    }
