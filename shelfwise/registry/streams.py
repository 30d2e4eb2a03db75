"""Streaming operators, run to the end of what the tables hold."""

from pyspark.sql import functions as F

from shelfwise import datasets as D
from shelfwise import schemas
from shelfwise.operators.snapshots import latest_per_key, merged_view
from shelfwise.plans.versions import VersionedViews
from shelfwise.registry.core import query
from shelfwise.registry.files import DRAINED_SQL, EVENT_SQL, PRODUCT_COLUMNS, PRODUCT_SQL, opened, published, written
from shelfwise.registry.tables import CUT_DAY, EVENT_COLUMNS
from shelfwise.session import scratch_path
from shelfwise.sources import messages
from shelfwise.streaming import realtime as R
from shelfwise.streaming import streams as S


def drained(spark, stream, schema):
    """Run an append stream over what is there and read back what it wrote."""
    path = scratch_path(spark, "stream")
    query_ = S.start_append(stream, path, scratch_path(spark, "stream-checkpoint"), available_now=True, compression="gzip")
    query_.awaitTermination()
    return spark.read.schema(schema).json(path)


@query("product_stream", PRODUCT_SQL, ("raw_products",))
def _(spark, sf):
    bus, _ = published(spark, sf, "products")
    stream = S.product_stream(bus.stream(spark, ("products",)))
    return drained(spark, stream, schemas.RAW_PRODUCT).select(*PRODUCT_COLUMNS).withColumn(
        "rating", F.round("rating", 6))


@query("review_stream", """
SELECT review_id, CAST(product_id AS VARCHAR) AS product_id, rating, sha256(comment) AS comment_sha256,
       CASE WHEN rating >= 4 THEN 1.0::DOUBLE WHEN rating = 3 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS sentiment_score
FROM raw_reviews""", ("raw_reviews",))
def _(spark, sf):
    stream = S.review_stream(S.file_stream(spark, "reviews", written(spark, sf, "reviews")))
    out = drained(spark, stream, "review_id string, product_id string, rating int, comment string, sentiment_score double")
    return out.withColumn("comment_sha256", F.sha2("comment", 256)).drop("comment")


@query("behavior_stream", """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(product_id AS VARCHAR) AS product_id, action, action_weight
FROM weighted""", ("weighted",))
def _(spark, sf):
    bus, _ = published(spark, sf, "user_behavior")
    stream = S.behavior_stream(bus.stream(spark, ("user_behavior",)))
    return drained(spark, stream, "user_id string, product_id string, action string, action_weight double")


@query("stream_settings", EVENT_SQL, ("ev",))
def _(spark, sf):
    path = written(spark, sf, "user_behavior")
    one_file = S.StreamSettings(max_files=1)
    return drained(spark, S.file_stream(spark, "user_behavior", path, one_file), schemas.RAW_EVENT)


def event_stream(spark, sf):
    """The events as a stream over parquet files laid out by day."""
    path = scratch_path(spark, "events")
    rows = D.events(spark, sf).select(*EVENT_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.partitionBy("action").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("live_interactions", "SELECT user_id, product_id, action_frequency, interaction_score FROM behavior",
       ("behavior",))
def _(spark, sf):
    path = scratch_path(spark, "live")
    running = R.live_interactions(event_stream(spark, sf), path, scratch_path(spark, "live-checkpoint"),
                                  availableNow=True)
    running.awaitTermination()
    return R.read_live(spark, path)


@query("realtime_views", """
SELECT user_id, product_id, event_id, action FROM newest_event""", ("newest_event",))
def _(spark, sf):
    """A published version of the first days, a refresh that folds in a stream of the next, and a stream after that."""
    rows = D.events(spark, sf).select(*EVENT_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = F.lit(f"{CUT_DAY} 00:00:00").cast("timestamp")
    source, path, checkpoint = (scratch_path(spark, n) for n in ("late-events", "speed", "speed-checkpoint"))
    keys, newest = ("user_id", "product_id"), ("ts", "event_id")
    views = VersionedViews(spark, scratch_path(spark, "views"))
    views.publish({"behavior": latest_per_key(rows.where(F.col("ts") < cut), keys, [F.col(c) for c in newest])}, -1)

    def stream(part):
        rows.where(part).write.mode("append").parquet(source)
        live = spark.readStream.schema(rows.schema).parquet(source)
        R.start_speed_layer(live, path, checkpoint, availableNow=True).awaitTermination()

    def build(fresh):
        return {"behavior": merged_view(views.read("behavior"), fresh, keys, [F.col(c) for c in newest])}

    stream((F.col("ts") >= cut) & (F.col("event_id") % 2 == 0))
    R.refresh(spark, views, path, build)
    stream((F.col("ts") >= cut) & (F.col("event_id") % 2 != 0))
    return R.refreshed_table(spark, views, "behavior", path, keys, newest).drop("ts")


@query("continuous_drain", DRAINED_SQL, ("ev",))
def _(spark, sf):
    bus, _ = published(spark, sf, "user_behavior")
    out = scratch_path(spark, "drain")
    messages.continuous_drain(spark, bus, out, scratch_path(spark, "drain-checkpoint"), ("user_behavior",),
                              available_now=True).awaitTermination()
    return opened(spark.read.schema(messages.MESSAGE).json(out))


@query("on_batch", "SELECT action, count(*) AS n FROM ev GROUP BY action", ("ev",))
def _(spark, sf):
    out = scratch_path(spark, "callback")

    def count_actions(batch, batch_id):
        batch.groupBy("action").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    messages.on_batch(event_stream(spark, sf), count_actions, scratch_path(spark, "callback-checkpoint"),
                      availableNow=True).awaitTermination()
    return spark.read.parquet(out).groupBy("action").agg(F.sum("n").alias("n"))


