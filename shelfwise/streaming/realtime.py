"""Views kept current by a stream and merged with batch views when read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from shelfwise.functions import columns as C
from shelfwise.operators.snapshots import merged_view
from shelfwise.plans.versions import Version, VersionedViews, folder_names, remove_folders

# How often each layer is refreshed.
REALTIME_INTERVAL, BATCH_INTERVAL = "60 seconds", "3600 seconds"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _write_delta(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # One folder per micro-batch: a repeated batch replaces itself.
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def live_interactions(
    events: DataFrame, path: str, checkpoint: str, event_id: str = "event_id",
    event_time: str = "ts", lateness: str = "1 day", **trigger,
) -> StreamingQuery:
    """What each micro-batch adds to the frequency and score per user and product, one folder per batch.

    Re-delivered events within the lateness are counted once. The state holds the ids of that
    span and nothing else: the totals are sums over folders (``read_live``), which
    compaction keeps few. The state lives in RocksDB, so it may outgrow the memory.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    once = events.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([event_id])
    scored = once.select("user_id", "product_id", C.action_weight("action").alias("weight"))
    write = _write_delta(path)

    def add(batch: DataFrame, batch_id: int) -> None:
        write(batch.groupBy("user_id", "product_id").agg(
            F.count(F.lit(1)).alias("action_frequency"), F.sum("weight").alias("interaction_score")), batch_id)

    return (
        scored.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": REALTIME_INTERVAL})).start()
    )


def live_totals(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(
        F.sum("action_frequency").alias("action_frequency"), F.sum("interaction_score").alias("interaction_score"))


def read_live(
    spark: SparkSession, path: str, keys: Sequence[str] = ("user_id", "product_id"), folded: VersionedViews | None = None
) -> DataFrame:
    """Totals per key: the newest compaction, if there is one, and the batches after it."""
    rows = spark.read.parquet(path)
    now = folded.current() if folded else None
    if now:
        later = rows.where(F.col("batch_id") > now.upto).drop("batch_id")
        rows = folded.read("live", now).unionByName(later)
    return live_totals(rows, keys)


def compact_live(
    spark: SparkSession, path: str, folded: VersionedViews, keys: Sequence[str] = ("user_id", "product_id")
) -> None:
    """Fold the batches so far into the next version, then remove batches that only the version before the last needs.

    Readers that hold the version before go on reading: its batches stay until the next compaction.
    """
    before = folded.current()
    newest = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    folded.publish({"live": read_live(spark, path, keys, folded)}, newest)
    if before:
        folded.expire(keep=2)
        remove_folders(spark, path, lambda name: name.startswith("batch_id=") and int(name[9:]) <= before.upto)


def start_speed_layer(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the rows of a base table as they come, one folder per micro-batch."""
    return (
        stream.writeStream.foreachBatch(_write_delta(path)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": REALTIME_INTERVAL})).start()
    )


def realtime_table(
    spark: SparkSession, batch: DataFrame | None, path: str, keys: Sequence[str], version: str | Sequence[str]
) -> DataFrame:
    """Batch rows overlaid with the newest streamed row per key; more version columns decide between equal first ones."""
    streamed = spark.read.parquet(path).drop("batch_id")
    versions = [version] if isinstance(version, str) else version
    return merged_view(batch, streamed, keys, [F.col(v) for v in versions])


def refreshed_table(
    spark: SparkSession, views: VersionedViews, name: str, path: str, keys: Sequence[str], version: str | Sequence[str],
    at: Version | None = None,
) -> DataFrame:
    """A view as its newest version (or the one given) holds it, overlaid with the stream batches after it."""
    at = at or views.current()
    streamed = spark.read.parquet(path).where(F.col("batch_id") > at.upto).drop("batch_id")
    versions = [version] if isinstance(version, str) else version
    return merged_view(views.read(name, at), streamed, keys, [F.col(v) for v in versions])


def refresh(
    spark: SparkSession, views: VersionedViews, path: str, build: Callable[[DataFrame | None], dict[str, DataFrame]], keep: int = 2
) -> Version:
    """Publish what ``build`` makes of the streamed rows so far as the next version; older ones than ``keep`` go.

    ``build`` gets the stream batches after the present version, or None where there are none.
    """
    now = views.current()
    upto = now.upto if now else -1
    rows = spark.read.parquet(path).where(F.col("batch_id") > upto) if folder_names(spark, path) else None
    newest = rows.agg(F.max("batch_id")).first()[0] if rows is not None else None
    fresh = None if newest is None else rows.where(F.col("batch_id") <= newest).drop("batch_id")
    made = views.publish(build(fresh), upto if newest is None else newest)
    views.expire(keep)
    return made


def schedule(spark: SparkSession, job: Callable[[], object], checkpoint: str, interval: str = BATCH_INTERVAL) -> StreamingQuery:
    """Run a job every interval, as the micro-batches of a clock; one that fails ends the query with its error."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(lambda batch, batch_id: job()).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )
