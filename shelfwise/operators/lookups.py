"""Views stored by key, so that a lookup reads the files of one bucket and of these the row groups of its key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a view: buckets by hash of the key. Within one, files are cut by size.
BUCKETS = 64
BUCKET = "_bucket"


@dataclass
class KeyedView:
    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = BUCKETS

    def _read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def all(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def of(self, value) -> DataFrame:
        """Rows of one key: one scan of one bucket, with the key pushed to its row groups and bloom filters."""
        wanted = F.lit(value).cast(self.schema[self.key].dataType)
        return self._read().where((F.col(BUCKET) == bucket_of(wanted, self.buckets)) & (F.col(self.key) == wanted)).drop(BUCKET)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store_by_key(df: DataFrame, key: str, path: str, order: Sequence[Column] = (), buckets: int = BUCKETS) -> KeyedView:
    """Write a view by key. ``order`` follows the key in the range sort that cuts the files, so a hot key is cut too."""
    keys = [F.col(BUCKET), F.col(key), *order]
    (
        df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy(BUCKET).parquet(path)
    )
    return KeyedView(df.sparkSession, path, key, df.schema, buckets)
