"""Keyed tables without an ACID format: newest row per key, merge, upsert and delete."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """Newest row per key. The filter on rank 1 also runs map-side, so hot keys arrive reduced."""
    newest = W.partitionBy(*keys).orderBy(*[column.desc_nulls_last() for column in version])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def latest_run(df: DataFrame, run: str = "run_ts") -> DataFrame:
    """Rows of the newest run; on a table partitioned by run, only its files are read."""
    newest = df.agg(F.max(run)).scalar()
    return df.where(F.col(run) == newest)


def merged_view(
    batch: DataFrame | None, realtime: DataFrame | None, keys: Sequence[str], version: Sequence[Column]
) -> DataFrame:
    """Batch and real-time rows by column name, newest wins; either side may be absent."""
    present = [df for df in (batch, realtime) if df is not None]
    if not present:
        raise ValueError("neither a batch nor a real-time table was given")
    if len(present) == 1:
        return present[0]
    merged = batch.unionByName(realtime, allowMissingColumns=True)
    return latest_per_key(merged, keys, version)


def accumulate(tables: Sequence[DataFrame], keys: Sequence[str] | None = None) -> DataFrame:
    """Union of increments; with keys, re-delivered rows are counted once."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return union.dropDuplicates(list(keys)) if keys else union


def upsert(table: DataFrame, changes: DataFrame, key: str, version: Sequence[Column]) -> DataFrame:
    """Table after creating or replacing the changed documents, newest version first."""
    return latest_per_key(table.unionByName(changes, allowMissingColumns=True), [key], version)


def get_document(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def delete_documents(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Table without the listed ids; ids that are not there are no error."""
    return table.join(ids.select(key), key, "left_anti")
