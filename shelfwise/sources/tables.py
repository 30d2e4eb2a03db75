"""Catalog tables, registered views and parameterised SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.ids import ordinal_ids


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")


def materialize_tables(
    spark: SparkSession, database: str, tables: Mapping[str, DataFrame], location: str | None = None
) -> None:
    """Create the database if absent, overwrite its tables, refresh what the session knows of them."""
    create_database(spark, database, location)
    for name, df in tables.items():
        full = f"`{database}`.`{name}`"
        df.write.mode("overwrite").format("parquet").saveAsTable(full)
        spark.catalog.refreshTable(full)


def register_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, query: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Any SQL over the registered views; values travel as named parameters, never as text."""
    return spark.sql(query, args=dict(args) if args else None)


def query_view(view: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return view.transform(transform)


def index_name(name: str, prefix: str = "", database: str | None = None) -> str:
    return f"`{database}`.`{prefix}{name}`" if database else f"`{prefix}{name}`"


def create_index(
    spark: SparkSession, name: str, schema: T.StructType, prefix: str = "", key: str = "doc_id",
    database: str | None = None,
) -> str:
    """Typed keyed table, created once; returns its full name."""
    full = index_name(name, prefix, database)
    columns = schema if key in schema.names else T.StructType([T.StructField(key, T.StringType()), *schema.fields])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({ddl}) USING parquet")
    return full


def delete_index(spark: SparkSession, name: str, prefix: str = "", database: str | None = None) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {index_name(name, prefix, database)}")


def bulk_load_index(
    df: DataFrame, name: str, id_field: str | None = None, order: list[str] | None = None
) -> tuple[int, int]:
    """Overwrite a keyed table; the id is a field, or the row's place in ``order``. Returns (loaded, given).

    Rows without an id are left out and show up as the difference of the two numbers.
    """
    if id_field:
        keyed = df.withColumn("doc_id", F.col(id_field).cast("string"))
    else:
        keyed = ordinal_ids(df, order or df.columns).withColumn("doc_id", F.col("doc_id").cast("string"))
    observed = Observation("loaded")
    given, loaded = F.count(F.lit(1)).alias("given"), F.count("doc_id").alias("loaded")
    keyed.observe(observed, given, loaded).where("doc_id is not null").write.mode("overwrite").format("parquet").saveAsTable(name)
    return observed.get["loaded"], observed.get["given"]
