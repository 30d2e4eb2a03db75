"""Views that lookups read: built once in a session from the given tables and stored by key in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from shelfwise.operators.lookups import KeyedView, store_by_key
from shelfwise.session import scratch_path

VIEWS: dict[tuple[str, str, str], KeyedView] = {}


def view(
    spark: SparkSession, sf: str, name: str, key: str, make: Callable[[SparkSession, str], DataFrame], order: Sequence[Column] = (),
) -> KeyedView:
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in VIEWS:
        VIEWS[at] = store_by_key(make(spark, sf), key, scratch_path(spark, f"view-{name}"), order)
    return VIEWS[at]
