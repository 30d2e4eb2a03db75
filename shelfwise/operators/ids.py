"""Dense integer ids without passing the keys through the driver or one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.session import scratch_path


def index_ids(df: DataFrame, column: str, index: str, buckets: int = 512) -> DataFrame:
    """Map each distinct value to 0..n-1.

    Values are numbered inside hash buckets; a bucket starts where the counts of the
    buckets before it end. Only the ``buckets``-row count table is ordered globally,
    and the mapping depends on nothing but the set of values.
    """
    keyed = (
        df.select(column).where(F.col(column).isNotNull()).distinct()
        .withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
    )
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    position = F.row_number().over(W.partitionBy("_bucket").orderBy(column))
    return (
        keyed.withColumn("_position", position)
        .join(starts, "_bucket")
        .select(column, (F.col("_start") + F.col("_position") - 1).cast("int").alias(index))
    )


def attach_indexes(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings with integer user and item numbers."""
    return ratings.join(users, "user_id").join(items, "product_id")


def deindex(recommendations: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Integer numbers back to the original ids."""
    return recommendations.join(users, "user_index").join(items, "item_index").drop("user_index", "item_index")


def ordinal_ids(df: DataFrame, order: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Number rows 0..n-1 in the given order.

    The rows are range-sorted once and stored with their partition and place in it; a
    partition starts where the counts of those before it end, one row per partition.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(T.StructType([*df.schema, T.StructField("_at", T.LongType())])).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at") - F.shiftleft(F.col("_part"), 33)
    # One row per partition; without the hint whole rows are shuffled by partition.
    return placed.join(F.broadcast(starts), "_part").withColumn(doc_id, number).select(*df.columns, doc_id)
