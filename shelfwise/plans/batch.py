"""The batch run: raw files to processed tables, recommendations and serving views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.datasets import enrich_products, enrich_reviews
from shelfwise.operators.interactions import interactions, popularity_baseline
from shelfwise.plans.views import serving_views
from shelfwise.sources.files import save_views, scan_processed, scan_raw, write_run


def run_batch(
    spark: SparkSession, raw: dict[str, str], base: str, run_ts: str, processed_date: str | None = None
) -> dict[str, DataFrame]:
    """Read, score and write each table once, then build on what was written. Errors are raised."""
    def publish(df: DataFrame, table: str) -> DataFrame:
        write_run(df, base, table, run_ts, processed_date)
        return scan_processed(spark, base, table)

    def valid(data_type: str) -> DataFrame:
        return scan_raw(spark, data_type, raw[data_type]).where("_corrupt_record is null").drop("_corrupt_record")

    products = publish(enrich_products(valid("products")), "products")
    reviews = publish(enrich_reviews(valid("reviews")), "reviews")
    behavior = publish(interactions(valid("user_behavior")), "user_behavior")
    recommendations = publish(
        popularity_baseline(behavior, products).withColumn("algorithm", F.lit("popularity"))
        .drop("run_ts", "processed_date"),
        "recommendations",
    )
    tables = {"products": products, "reviews": reviews, "user_behavior": behavior,
              "recommendations": recommendations}
    views = serving_views(products, reviews, behavior, recommendations, ("popularity",))
    save_views(views, f"{base}/views")
    return tables
