"""JSON messages to typed rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.schemas import with_corrupt

STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_message(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Replace the JSON ``value`` by its fields; malformed text lands in ``_corrupt_record``."""
    text = F.col(value).cast("string")
    parsed = F.from_json(
        text, with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    others = [c for c in df.columns if c != value]
    return df.select(*others, parsed.alias("_parsed")).select(*others, "_parsed.*")


def encode_message(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key`` and JSON ``value`` columns, the shape a message sink expects."""
    encoded = F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")
    if key is None:
        return df.select(encoded)
    return df.select(F.col(key).cast("string").alias("key"), encoded)


def stamp_if_missing(df: DataFrame, column: str = "timestamp", as_of: Column | None = None) -> DataFrame:
    """Fill a missing time with the arrival time."""
    now = as_of if as_of is not None else F.date_format(F.current_timestamp(), STAMP_FORMAT)
    present = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.coalesce(present, now))


def route_topic(path: Column) -> Column:
    """Topic by file name; the first matching word wins, products otherwise."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.contains("product"), "products")
        .when(name.contains("review"), "reviews")
        .when(name.contains("user") | name.contains("behavior"), "user_behavior")
        .otherwise("products")
    )
