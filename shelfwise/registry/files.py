"""Readers and writers: tables go out to the shared folder and come back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise import schemas
from shelfwise.operators import search as S
from shelfwise.plans.batch import run_batch
from shelfwise.plans.views import product_views
from shelfwise.registry.core import query
from shelfwise.registry.serving import RECS_SQL, rounded_recs
from shelfwise.registry.tables import behavior
from shelfwise.session import scratch_path
from shelfwise.sources import files, messages, tables


def raw_json(spark, sf, data_type: str, **of_length) -> DataFrame:
    """Rows of a raw table as the collectors leave them: text ids and times. ``of_length`` chooses reviews as ``datasets.reviews`` does."""
    def text(column: str):
        return F.col(column).cast("string").alias(column)

    if data_type == "products":
        return D.raw_products(spark, sf).withColumn("product_id", text("product_id"))
    if data_type == "reviews":
        return D.reviews(spark, sf, texts=True, **of_length).select(
            "review_id", text("product_id"), "username", "rating", "comment",
            F.date_format("time", "yyyy-MM-dd").alias("time"),
        )
    return D.events(spark, sf).select(
        text("user_id"), text("product_id"), "action",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )


def written(spark, sf, data_type: str) -> str:
    path = scratch_path(spark, f"raw-{data_type}")
    if data_type != "reviews":
        return files.write_raw(raw_json(spark, sf, data_type), path)
    # Every row carries its whole comment, and many rows the same one.
    files.write_raw(raw_json(spark, sf, data_type, up_to=files.GZIP_REACH), path)
    return files.write_raw(raw_json(spark, sf, data_type, longer_than=files.GZIP_REACH), path, "lz4")


def json_arrays(df: DataFrame, path: str) -> str:
    """Write a table as files that each hold one JSON array."""
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            rows = [("[" if first and i == 0 else ",") + v for i, v in enumerate(batch["value"])]
            first = first and not rows
            yield pd.DataFrame({"value": rows})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(lines, "value string").write.text(path)
    return path


EVENT_SQL = """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, action,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ev"""
PRODUCT_SQL = """SELECT CAST(product_id AS VARCHAR) AS product_id, name, price, round(rating, 6) AS rating, sold,
 location, url, category, brand FROM raw_products"""
PRODUCT_COLUMNS = ("product_id", "name", "price", "rating", "sold", "location", "url", "category", "brand")


@query("scan_raw_products", PRODUCT_SQL, ("raw_products",))
def _(spark, sf):
    path = written(spark, sf, "products")
    # The first place does not exist: the reader falls back to the second.
    return files.scan_raw_products(spark, f"{path}-local", path).select(*PRODUCT_COLUMNS).withColumn(
        "rating", F.round("rating", 6))


@query("scan_raw_reviews", """
SELECT review_id, CAST(product_id AS VARCHAR) AS product_id, username, rating, strftime(time, '%Y-%m-%d') AS time,
       sha256(comment) AS comment_sha256, review_weight
FROM raw_reviews""", ("raw_reviews",))
def _(spark, sf):
    scanned = D.enrich_reviews(files.scan_raw_reviews(spark, written(spark, sf, "reviews")))
    return scanned.select(
        "review_id", "product_id", "username", "rating", "time", F.sha2("comment", 256).alias("comment_sha256"), "review_weight")


@query("scan_raw_behavior", EVENT_SQL, ("ev",))
def _(spark, sf):
    return files.scan_raw_behavior(spark, written(spark, sf, "user_behavior")).drop("_corrupt_record")


@query("scan_processed", """
SELECT user_id, product_id, action_frequency, interaction_score, '2024-01-31' AS processed_date,
       '20240131' AS run_ts FROM behavior""", ("behavior",))
def _(spark, sf):
    base = scratch_path(spark, "processed")
    first_days = behavior(spark, sf).where("interaction_score > 3")
    files.write_run(first_days, base, "user_behavior", "20240130", "2024-01-30")
    files.write_run(behavior(spark, sf), base, "user_behavior", "20240131", "2024-01-31")
    return files.scan_processed(spark, base, "user_behavior")


@query("write_run", """
SELECT '20240131' AS run_ts, '2024-01-31' AS processed_date, count(*) AS n FROM behavior
UNION ALL SELECT '20240130', '2024-01-30', count(*) FROM behavior WHERE interaction_score > 3""", ("behavior",))
def _(spark, sf):
    base = scratch_path(spark, "runs")
    files.write_run(behavior(spark, sf).where("interaction_score > 3"), base, "user_behavior", "20240130", "2024-01-30")
    files.write_run(behavior(spark, sf), base, "user_behavior", "20240131", "2024-01-31")
    runs = files.scan_processed(spark, base, "user_behavior", newest_only=False)
    return runs.groupBy("run_ts", "processed_date").agg(F.count(F.lit(1)).alias("n"))


@query("scan_json_array", EVENT_SQL, ("ev",))
def _(spark, sf):
    path = json_arrays(raw_json(spark, sf, "user_behavior"), scratch_path(spark, "arrays"))
    return files.scan_json_array(spark, path, schemas.RAW_EVENT)


@query("scan_directory", "SELECT count(*) AS rows, 2 AS folders FROM (SELECT 1 FROM ev UNION ALL SELECT 1 FROM ev)",
       ("ev",))
def _(spark, sf):
    base = scratch_path(spark, "folder")
    for part in ("a", "b"):
        json_arrays(raw_json(spark, sf, "user_behavior"), f"{base}/{part}")
    loaded = files.scan_directory(spark, base, "part-*.txt", schemas.RAW_EVENT)
    per_file = files.rows_per_file(loaded)
    return per_file.agg(F.sum("rows").alias("rows"), F.lit(2).alias("folders"))


def _saved(fmt: str):
    def run(spark, sf):
        path = scratch_path(spark, f"result-{fmt}")
        out = behavior(spark, sf)
        files.save_result(out, path, fmt)
        reader = spark.read.schema(out.schema)
        return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
    return run


for _fmt in files.FORMATS:
    query(f"save_result_{_fmt}", "SELECT * FROM behavior", ("behavior",))(_saved(_fmt))


@query("export_csv", EVENT_SQL, ("ev",))
def _(spark, sf):
    source = json_arrays(raw_json(spark, sf, "user_behavior"), scratch_path(spark, "export-in"))
    target = scratch_path(spark, "export-out")
    files.export_csv(spark, source, target, schemas.RAW_EVENT)
    return spark.read.schema(schemas.RAW_EVENT).option("header", True).csv(target)


@query("write_zone", "SELECT * FROM behavior", ("behavior",))
def _(spark, sf):
    out = behavior(spark, sf)
    path = files.write_zone(out, scratch_path(spark, "zones"), "user_behavior", "scores", "csv")
    return spark.read.schema(out.schema).option("header", True).csv(path)


def _database(spark) -> tuple[str, str]:
    location = scratch_path(spark, "shelfwise_db")
    return location.rsplit("/", 1)[1].replace("-", "_"), location


@query("materialize_tables", """
SELECT 'user_behavior' AS name, count(*) AS n FROM behavior UNION ALL SELECT 'products', count(*) FROM products""",
       ("behavior", "products"))
def _(spark, sf):
    name, location = _database(spark)
    made = {"user_behavior": behavior(spark, sf), "products": D.products(spark, sf)}
    tables.materialize_tables(spark, name, made, location)
    counts = [spark.table(f"{name}.{t}").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in made]
    return counts[0].unionByName(counts[1])


@query("create_index", """
SELECT product_id AS doc_id, name, category FROM products""", ("products",))
def _(spark, sf):
    name, location = _database(spark)
    tables.create_database(spark, name, location)
    rows = D.catalog_text(spark, sf).select(F.col("product_id").alias("doc_id"), "name", "category")
    full = tables.create_index(spark, "catalog", rows.schema, "shop_", database=name)
    # Creating it again changes nothing; dropping one that is not there is no error.
    tables.create_index(spark, "catalog", rows.schema, "shop_", database=name)
    tables.delete_index(spark, "other", "shop_", database=name)
    rows.write.mode("append").insertInto(full)
    return spark.table(full)


@query("bulk_load_index", """
SELECT CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS VARCHAR) AS doc_id, p_partkey AS product_id,
       p_name AS name FROM part""")
def _(spark, sf):
    name, location = _database(spark)
    tables.create_database(spark, name, location)
    rows = D.catalog_text(spark, sf).select("product_id", "name")
    tables.bulk_load_index(rows, f"{name}.catalog", order=["name", "product_id"])
    return spark.table(f"{name}.catalog")


@query("save_views", """
SELECT category, count(*) AS product_count, round(avg(rating), 6) AS avg_rating FROM products GROUP BY category""",
       ("products",))
def _(spark, sf):
    base = scratch_path(spark, "views")
    files.save_views(product_views(D.products(spark, sf)), base)
    view = files.load_views(spark, base, ("top_products", "products_by_category"))["products_by_category"]
    return view.select("category", "product_count", F.round("avg_rating", 6).alias("avg_rating"))


@query("publish_file", """
SELECT 'user_behavior' AS topic, CAST(user_id AS VARCHAR) AS key, CAST(product_id AS VARCHAR) AS product_id, action
FROM ev""", ("ev",))
def _(spark, sf):
    bus = messages.Bus.files(scratch_path(spark, "bus"))
    source = json_arrays(raw_json(spark, sf, "user_behavior"), scratch_path(spark, "arrays"))
    messages.publish_file(spark, bus, source, schemas.RAW_EVENT, topic="user_behavior", key="user_id")
    sent = bus.batch(spark, ("user_behavior",))
    body = F.from_json("value", schemas.RAW_EVENT)
    return sent.select("topic", "key", body["product_id"].alias("product_id"), body["action"].alias("action"))


def published(spark, sf, data_type: str) -> tuple[messages.Bus, str]:
    """A bus that holds a raw table, published from its files."""
    source = written(spark, sf, data_type)
    bus = messages.Bus.files(scratch_path(spark, "bus"))
    key = {"user_behavior": "user_id"}.get(data_type, "product_id")
    rows = spark.read.schema(schemas.RAW[data_type]).json(source)
    bus.publish(messages.to_messages(rows, data_type, key))
    return bus, source


DRAINED_SQL = """
SELECT 'user_behavior' AS topic, CAST(user_id AS VARCHAR) AS key, CAST(product_id AS VARCHAR) AS product_id, action,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ev"""


def opened(drained: DataFrame) -> DataFrame:
    """Drained messages with what their bodies say."""
    body = F.from_json("value", schemas.RAW_EVENT)
    return drained.select("topic", "key", *(body[c].alias(c) for c in ("product_id", "action", "timestamp")))


@query("drain_topics", DRAINED_SQL, ("ev",))
def _(spark, sf):
    bus, _ = published(spark, sf, "user_behavior")
    out = scratch_path(spark, "drained")
    messages.drain_topics(spark, bus, out, ("user_behavior",))
    return opened(spark.read.schema(messages.MESSAGE).json(out))


@query("read_postings", """
SELECT term, id, count(*) AS tf, CAST(min(position) AS INTEGER) AS first_position FROM doc_terms
WHERE term IN ('the', 'que', 'der') GROUP BY term, id""", ("doc_terms",))
def _(spark, sf):
    path = scratch_path(spark, "postings")
    S.write_inverted_index(S.build_inverted_index(D.load(spark, sf, "documents"), "doc_id", "text"), path)
    return S.read_postings(spark, path, ("the", "que", "der")).drop("bucket")


@query("run_batch", "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, "
       + RECS_SQL.replace("user_id, product_id,", "") + " FROM baseline", ("baseline",))
def _(spark, sf):
    raw = {t: written(spark, sf, t) for t in schemas.RAW}
    out = run_batch(spark, raw, scratch_path(spark, "batch"), "20240131", "2024-01-31")
    recs = out["recommendations"].drop("run_ts", "processed_date", "algorithm", "action_frequency")
    return rounded_recs(recs)


