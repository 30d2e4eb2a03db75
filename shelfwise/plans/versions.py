"""Views in versions: readers keep the one they started with while the next one is written.

A version is a folder of tables. It becomes the current one when its row in the table of
manifests is committed, which is a single rename; until then no reader looks at it. A
version's number is part of every path, so nothing is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    number: int
    #: The newest stream batch that the version holds.
    upto: int


def _files(spark: SparkSession, path: str):
    """(file system, path) as the session reaches them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where it is not there."""
    system, where = _files(spark, path)
    if not system.exists(where):
        return []
    return [status.getPath().getName() for status in system.listStatus(where) if status.isDirectory()]


def remove_folders(spark: SparkSession, path: str, which: Callable[[str], bool]) -> list[str]:
    """Remove the folders below a path that are chosen by name."""
    system, where = _files(spark, path)
    gone = [name for name in folder_names(spark, path) if which(name)]
    for name in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(where, name), True)
    return gone


class VersionedViews:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _numbers(self) -> list[int]:
        """Versions with a committed manifest."""
        out = []
        for name in folder_names(self.spark, f"{self.base}/manifests"):
            if name.startswith("version="):
                system, where = _files(self.spark, f"{self.base}/manifests/{name}/_SUCCESS")
                if system.exists(where):
                    out.append(int(name[8:]))
        return sorted(out)

    def current(self) -> Version | None:
        numbers = self._numbers()
        if not numbers:
            return None
        row = self.spark.read.schema("upto long").parquet(f"{self.base}/manifests/version={numbers[-1]}").first()
        return Version(numbers[-1], row[0])

    def publish(self, views: dict[str, DataFrame], upto: int) -> Version:
        """Write all views of the next version, then its manifest."""
        known = [*self._numbers(), *(int(n[8:]) for n in folder_names(self.spark, f"{self.base}/data") if n.startswith("version="))]
        number = max(known, default=0) + 1  # also after a version that was never finished
        for name, df in views.items():
            df.write.mode("overwrite").parquet(f"{self.base}/data/version={number}/{name}")
        manifest = self.spark.range(1).select(F.lit(upto).cast("long").alias("upto"))
        manifest.write.mode("overwrite").parquet(f"{self.base}/manifests/version={number}")
        return Version(number, upto)

    def read(self, name: str, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise LookupError(f"no version of {name!r} was published")
        return self.spark.read.parquet(f"{self.base}/data/version={version.number}/{name}")

    def expire(self, keep: int = 2) -> None:
        """Remove versions before the newest ``keep``: first their manifests, then their tables."""
        gone = set(self._numbers()[:-keep])
        for folder in ("manifests", "data"):
            remove_folders(self.spark, f"{self.base}/{folder}", lambda name: name.startswith("version=") and int(name[8:]) in gone)
