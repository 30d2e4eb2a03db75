"""Helpers shared by the operators: reading a table, the held-out fold, stored intermediate tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.session import scratch_path

FOLDS = 4
HELD_OUT = 2


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """Fold of a document: crc32 of its id as text, modulo four; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by_hash(df: DataFrame, per: Iterable[str], n: int) -> DataFrame:
    """A sample of at most n rows of each group, in the order of a hash of doc_id: the same rows however the table is dealt.

    From the groups' sizes, rows whose hash can hardly be among the first n are dropped
    before the shuffle, so that a group's ranking gets some 4 * n rows whatever its size.
    """
    sizes = df.groupBy(*per).agg(F.count(F.lit(1)).alias("_size"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    near = df.join(sizes, list(per)).where(place * F.col("_size") < 4 * n)
    window = Window.partitionBy(*per).orderBy(place, "doc_id")
    return near.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank", "_size")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
