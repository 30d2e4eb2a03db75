"""Keyed tables in files: changes rewrite only the buckets of their keys.

A table is a Parquet folder partitioned by a hash bucket of the key. Upserts and deletes read
and replace the buckets that hold changed keys (dynamic partition overwrite: new files are
complete in a staging folder before old ones go), lookups read one bucket. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.snapshots import latest_per_key

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """``version`` orders the rows of one key, newest first; ``buckets`` stays as the table was created with."""

    spark: SparkSession
    path: str
    key: str
    key_type: T.DataType
    version: Sequence[Column]
    buckets: int = 256

    def _place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.key_type)), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, self._place(F.col(self.key)))

    def _write(self, df: DataFrame) -> None:
        # A bucket's keys are dealt over four tasks, so that none writes a whole bucket.
        part = F.floor(F.pmod(F.xxhash64(F.col(self.key).cast(self.key_type)), F.lit(4 * self.buckets)) / self.buckets)
        rows = df.repartition(BUCKET, part)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _touched(self, changes: DataFrame) -> list[int]:
        """Buckets that hold a changed key: at most as many as the table has."""
        return [r[BUCKET] for r in self._placed(changes.select(self.key)).select(BUCKET).distinct().collect()]

    def create(self, df: DataFrame) -> None:
        self._write(self._placed(latest_per_key(df, [self.key], self.version)))

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def get(self, value) -> DataFrame:
        return self._stored().where((F.col(BUCKET) == self._place(F.lit(value))) & (F.col(self.key) == F.lit(value))).drop(BUCKET)

    def upsert(self, changes: DataFrame) -> None:
        """Create or replace documents; of the rows of one key the newest version stays."""
        touched = self._touched(changes)
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(touched))
            self._write(latest_per_key(old.unionByName(self._placed(changes), allowMissingColumns=True), [self.key], self.version))

    def delete(self, ids: DataFrame) -> None:
        """Remove the listed keys; keys that are not there are no error."""
        touched = self._touched(ids)
        if not touched:
            return
        left = self._stored().where(F.col(BUCKET).isin(touched)).join(ids.select(self.key), self.key, "left_anti")
        kept = {r[BUCKET] for r in left.select(BUCKET).distinct().collect()}
        if kept:
            self._write(left)
        # A bucket without rows is not overwritten: it goes as a folder.
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for bucket in set(touched) - kept:
            folder = hadoop.Path(f"{self.path}/{BUCKET}={bucket}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
