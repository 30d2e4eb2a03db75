"""File readers and writers: raw JSON, run-partitioned parquet, exports and zones."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.schemas import RAW, with_corrupt

PROCESSED = ("products", "reviews", "user_behavior", "recommendations")
ZONES = ("raw", "processed", "products", "reviews", "user_behavior")
FORMATS = ("json", "csv", "parquet")
#: Rows of a raw file: compressed files are read by one task each.
RAW_ROWS = 50_000
#: Bytes of a text that gzip, which looks back 32 KB, can find again in the next row.
GZIP_REACH = 30_000
#: Distinct values of a column that a part of a processed table keeps once; many reviews share a long comment.
DICTIONARY_BYTES = 16 << 20


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path))


def newest_run(spark: SparkSession, table: str) -> str | None:
    """Folder of the newest run that holds data, found by names alone."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/run_ts=*")
    folders = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path) or []
    runs = sorted(((unquote(f.getPath().getName().split("=", 1)[1]), f.getPath().toString()) for f in folders), reverse=True)
    return next((path for _, path in runs if _exists(spark, f"{path}/*.parquet")), None)


def scan_raw(spark: SparkSession, data_type: str, *paths: str) -> DataFrame:
    """JSON lines under a declared schema, from the first of the given places that exists.

    Lines that do not parse stay as rows with their text in ``_corrupt_record``.
    """
    if data_type not in RAW:
        raise ValueError(f"unknown raw table {data_type!r}, expected one of {sorted(RAW)}")
    for path in paths:
        if _exists(spark, path):
            return (
                spark.read.schema(with_corrupt(RAW[data_type]))
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            )
    raise FileNotFoundError(f"none of {paths} exists")


def write_raw(df: DataFrame, path: str, codec: str = "gzip") -> str:
    """JSON lines as compressed files of bounded length, rows in the order they come in: a long text that
    neighbouring rows share is stored about once a file. Files are added to those of the folder.

    gzip does so with texts of up to ``GZIP_REACH`` bytes; for longer ones lz4 reaches twice as far.
    """
    df.write.mode("append").option("maxRecordsPerFile", RAW_ROWS).option("compression", codec).json(path)
    return path


def scan_raw_products(spark: SparkSession, *paths: str) -> DataFrame:
    return scan_raw(spark, "products", *paths)


def scan_raw_reviews(spark: SparkSession, *paths: str) -> DataFrame:
    return scan_raw(spark, "reviews", *paths)


def scan_raw_behavior(spark: SparkSession, *paths: str) -> DataFrame:
    return scan_raw(spark, "user_behavior", *paths)


def write_run(df: DataFrame, base: str, table: str, run_ts: str, processed_date: str | Column | None = None) -> str:
    """Add one run to a table partitioned by run; rerunning the same run replaces it."""
    if processed_date is None:
        processed_date = F.date_format(F.current_date(), "yyyy-MM-dd")
    elif isinstance(processed_date, str):
        processed_date = F.lit(processed_date)
    path = f"{base}/{table}"
    writer = df.withColumn("processed_date", processed_date).write.mode("overwrite").option("compression", "zstd")
    writer.option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(f"{path}/run_ts={run_ts}")
    return path


def scan_processed(spark: SparkSession, base: str, data_type: str, newest_only: bool = True) -> DataFrame:
    """A processed table; by default its newest run, whose files alone are listed and read."""
    if data_type not in PROCESSED:
        raise ValueError(f"unknown table {data_type!r}, expected one of {PROCESSED}")
    table = f"{base}/{data_type}"
    newest = newest_run(spark, table) if newest_only else None
    runs = spark.read.option("basePath", table).parquet(newest or f"{table}/run_ts=*")
    return runs.withColumn("run_ts", F.col("run_ts").cast("string"))


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_directory(spark: SparkSession, path: str, pattern: str, schema: T.StructType) -> DataFrame:
    """All files of a folder whose names match, with the name of each row's file."""
    return (
        spark.read.schema(schema).option("multiLine", True)
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("file_name").agg(F.count(F.lit(1)).alias("rows"))


def save_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def export_csv(spark: SparkSession, json_path: str, csv_path: str, schema: T.StructType) -> None:
    """JSON array, object or several files to CSV with a header."""
    rows = scan_json_array(spark, json_path, schema)
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(csv_path)


def write_zone(df: DataFrame, base: str, zone: str, name: str, fmt: str = "parquet") -> str:
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}, expected one of {ZONES}")
    path = f"{base}/{zone}/{name}"
    save_result(df, path, fmt)
    return path


def save_views(views: Mapping[str, DataFrame], base: str) -> None:
    for name, view in views.items():
        view.write.mode("overwrite").parquet(f"{base}/{name}")


def load_views(spark: SparkSession, base: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base}/{name}") for name in names if _exists(spark, f"{base}/{name}")}
