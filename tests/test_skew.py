"""Joins in which one key holds a third of all rows."""

import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.operators import hybrid as H
from shelfwise.operators import interactions as I
from shelfwise.operators import similarity as S
from shelfwise.operators import skew
from shelfwise.operators import text as X


@pytest.fixture
def split(spark, monkeypatch):
    """Keys are hot from 500 rows on; partitions are left as the shuffle makes them."""
    for f in (skew.join_counted, skew.join_unique):
        defaults = list(f.__defaults__)
        defaults[defaults.index(skew.HOT_ROWS)] = 500
        monkeypatch.setattr(f, "__defaults__", tuple(defaults))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    """user_id 7 has a third of the rows, and so has product_id 3."""
    data = [(7 if k % 3 == 0 else k % 900, 3 if k % 3 == 1 else 10_000 + k, float(k % 5 + 1)) for k in range(9000)]
    return spark.createDataFrame(data, "user_id long, product_id long, interaction_score double").repartition(5).cache()


def even(df):
    """No task holds over twice the median."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return len(sizes) == 6 and max(sizes) <= 2 * statistics.median(sizes)


def test_hot_keys_are_dealt_out(split, spark, hot):
    products = spark.createDataFrame([(i, "n", "1", 1.0, 2.0) for i in [3, *range(10_000, 19_000)]],
                                     "product_id long, name string, price string, rating double, popularity_score double")
    assert even(S.unit_vectors(hot, "user_id", "product_id", "interaction_score"))
    assert even(H.max_normalise(hot, "interaction_score"))
    joined = I.with_products(hot, products)
    assert even(joined) and joined.count() == 9000
    texts = hot.select(F.monotonically_increasing_id().alias("id"), F.col("user_id").cast("string").alias("t"))
    _, members = X.distinct_texts(texts, "id", "t")
    assert even(members) and members.count() == 9000
    # A third of the ids have one and the same vector.
    vectors = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("dim"), F.lit(1.0).alias("w"))
    classes = S.profile_classes(vectors)
    assert even(classes) and classes.where("class = 0").count() == 3000


def test_splitting_changes_no_result(split, spark, hot, monkeypatch):
    largest = hot.groupBy("user_id").agg(F.max("interaction_score").alias("m"), F.count(F.lit(1)).alias("_n"))
    plain = hot.join(largest.drop("_n"), "user_id")
    assert rows(skew.join_counted(hot, largest, "user_id"), *plain.columns) == rows(plain)
    some = spark.createDataFrame([(3, "a"), (10_001, "b")], "product_id long, name string")
    kept = hot.join(some, "product_id", "left")
    assert rows(skew.join_unique(hot, some, "product_id", "left"), *kept.columns) == rows(kept)
    assert skew.join_unique(hot.limit(0), some, "product_id").count() == 0
