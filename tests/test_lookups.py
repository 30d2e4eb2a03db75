"""Views stored by key."""

from conftest import rows
from pyspark.sql import functions as F

from shelfwise.operators.lookups import store_by_key


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    """A third of all rows have one key; nulls, absent keys and other types of the value are no trouble."""
    data = [(7 if k % 3 == 0 else k % 50 if k % 11 else None, k, "x" * (k % 5)) for k in range(6000)]
    df = spark.createDataFrame(data, "user_id long, n int, _other string").repartition(6)
    view = store_by_key(df, "user_id", str(tmp_path / "v"), [F.col("n")], buckets=16)
    assert rows(view.all()) == rows(df)
    for key in (7, 3, 49, 1000, "8"):
        assert rows(view.of(key)) == rows(df.where(F.col("user_id") == int(key)))
    plan = view.of(3)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan and "xxhash64" not in plan  # the bucket is a constant that prunes folders
    scanned = view.of(3).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("/")[-2] for r in scanned}) == 1
    assert store_by_key(df.limit(0), "user_id", str(tmp_path / "none")).of(3).count() == 0
