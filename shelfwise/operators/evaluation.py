"""Hold-out metrics, algorithm comparisons and request latency summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.functions.filters import filter_user
from shelfwise.operators.quantiles import bracket, percentile_within
from shelfwise.session import cut_lineage
from shelfwise.operators.ranking import top_n


def ranking_metrics(recommended: DataFrame, relevant: DataFrame) -> DataFrame:
    """Precision, recall and F1 per algorithm, averaged over the users of the hold-out.

    ``recommended`` holds (algorithm, user_id, product_id), ``relevant`` distinct
    (user_id, product_id). Users without a list score 0.
    """
    held = relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    hit = relevant.select("user_id", "product_id", F.lit(1).alias("hit"))
    per_user = (
        recommended.join(hit, ["user_id", "product_id"], "left")
        .groupBy("algorithm", "user_id")
        .agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("hits"))
    )
    users = held.agg(F.count(F.lit(1))).scalar()
    sums = (
        per_user.join(held, "user_id")
        .groupBy("algorithm")
        .agg(
            F.sum(F.col("hits") / F.col("listed")).alias("p"),
            F.sum(F.col("hits") / F.col("held")).alias("r"),
            F.count(F.lit(1)).alias("users_reached"),
        )
    )
    precision, recall = F.col("p") / users, F.col("r") / users
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(
        "algorithm", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        (F.col("users_reached") / users).alias("user_coverage"),
    )


def compare_algorithms(
    recommendations: DataFrame, algorithms: Sequence[str], user_id=None, limit: int = 5
) -> DataFrame:
    """Top list per algorithm, side by side in long form, for one user or for all."""
    rows = recommendations.where(F.col("algorithm").isin(list(algorithms)) & F.col("score").isNotNull())
    if user_id is not None:
        rows = filter_user(rows, user_id)
    return top_n(rows, ["user_id", "algorithm"], "score", "product_id", limit)


def product_score_table(
    recommendations: DataFrame, columns: Sequence[str] = ("cf", "mf", "hybrid")
) -> DataFrame:
    """Scores side by side per user and product with the winning algorithm; absent scores are 0."""
    wide = (
        recommendations.groupBy("user_id", "product_id")
        .pivot("algorithm", list(columns)).agg(F.max("score")).na.fill(0.0, list(columns))
    )
    return wide.withColumn("best_algorithm", C.best_algorithm(*columns, labels=columns))


def latency_summary(requests: DataFrame) -> DataFrame:
    """Success rate, response times of successful requests, p95 and throughput per endpoint, in three scans."""
    ok = F.col("success")
    time = F.when(ok, F.col("response_time"))
    span = F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")
    # One row per endpoint, kept: it starts the percentile and ends as the summary.
    basic = cut_lineage(requests.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate"),
        F.avg(time).alias("avg_time"), F.min(time).alias("min_time"), F.max(time).alias("max_time"),
        (F.count(F.lit(1)) / F.nullif(span, F.lit(0.0))).alias("requests_per_second"),
        *bracket(time, 0.95),
    ))
    p95 = percentile_within(requests, basic, "endpoint", time, 0.95, "p95_time")
    return basic.drop("_n", "_near").join(p95, "endpoint", "left")
