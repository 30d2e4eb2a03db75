"""Topics: the same code over a message broker or, where its connector is absent, over files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql import types as T

from shelfwise.functions.messages import encode_message, route_topic, stamp_if_missing
from shelfwise.sources.files import scan_json_array

TOPICS = ("products", "reviews", "user_behavior")
MESSAGE = "key string, value string, topic string"

# Delivery settings of the message writer.
PRODUCER_OPTIONS = {
    "kafka.acks": "all", "kafka.retries": "3", "kafka.linger.ms": "10", "kafka.batch.size": "16384",
}


@dataclass(frozen=True)
class Bus:
    """Where messages live: a format with its options."""

    fmt: str
    options: dict[str, str] = field(default_factory=dict)
    path: str | None = None

    @classmethod
    def broker(cls, servers: str) -> Bus:
        return cls("kafka", {"kafka.bootstrap.servers": servers})

    @classmethod
    def files(cls, path: str) -> Bus:
        return cls("json", {}, path)

    def _selection(self, topics: Sequence[str], starting: str) -> dict[str, str]:
        if self.fmt != "kafka":
            return dict(self.options)
        return {**self.options, "subscribe": ",".join(topics), "startingOffsets": starting,
                "failOnDataLoss": "false"}

    def _messages(self, loaded: DataFrame, topics: Sequence[str]) -> DataFrame:
        text = loaded.select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic"
        )
        return text.where(F.col("topic").isin(list(topics)))

    def _reader(self, reader, options: dict[str, str]):
        reader = reader.format(self.fmt).options(**options)
        return reader if self.fmt == "kafka" else reader.schema(MESSAGE)

    def stream(self, spark: SparkSession, topics: Sequence[str] = TOPICS, starting: str = "latest", **limits) -> DataFrame:
        """Endless messages; ``limits`` are rate options of the source."""
        reader = self._reader(spark.readStream, {**self._selection(topics, starting), **limits})
        return self._messages(reader.load(self.path) if self.path else reader.load(), topics)

    def batch(self, spark: SparkSession, topics: Sequence[str] = TOPICS, starting: str = "earliest") -> DataFrame:
        """All messages there are now."""
        reader = self._reader(spark.read, self._selection(topics, starting))
        return self._messages(reader.load(self.path) if self.path else reader.load(), topics)

    def publish(self, messages: DataFrame) -> None:
        """Write (key, value, topic) rows."""
        writer = messages.write.mode("append").format(self.fmt).options(**self.options)
        if self.fmt == "kafka":
            writer.options(**PRODUCER_OPTIONS).save()
        else:
            writer.partitionBy("topic").save(self.path)


def to_messages(df: DataFrame, topic: str | Column, key: str | None = None) -> DataFrame:
    topic = F.lit(topic) if isinstance(topic, str) else topic
    encoded = encode_message(df, key)
    if key is None:
        encoded = encoded.select(F.lit(None).cast("string").alias("key"), "value")
    return encoded.withColumn("topic", topic)


def publish_file(
    spark: SparkSession, bus: Bus, path: str, schema: T.StructType, topic: str | None = None,
    key: str | None = None, as_of: Column | None = None,
) -> int:
    """File rows to a topic, by file name where none is given; returns how many. A failed write raises."""
    rows = scan_json_array(spark, path, schema).withColumn("_path", F.col("_metadata.file_path"))
    target = F.lit(topic) if topic else route_topic(F.col("_path"))
    observed = Observation("published")
    data = stamp_if_missing(rows.drop("_path"), as_of=as_of)
    body = F.to_json(F.struct(*[F.col(c) for c in data.columns]))
    messages = stamp_if_missing(rows, as_of=as_of).select(
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        body.alias("value"), target.alias("topic"),
    )
    bus.publish(messages.observe(observed, F.count(F.lit(1)).alias("sent")))
    return observed.get["sent"]


def drain_topics(spark: SparkSession, bus: Bus, out: str, topics: Sequence[str] = TOPICS, fmt: str = "json",
                 max_messages: int | None = None) -> None:
    """Bounded read, one folder per topic. ``max_messages`` is the size of a drain, as a consumer asks for it."""
    messages = bus.batch(spark, topics)
    if max_messages is not None:
        messages = messages.limit(max_messages)
    writer = messages.write.mode("overwrite").format(fmt).partitionBy("topic")
    (writer.option("header", True) if fmt == "csv" else writer).save(out)


def continuous_drain(
    spark: SparkSession, bus: Bus, out: str, checkpoint: str, topics: Sequence[str] = TOPICS,
    save_interval: str = "60 seconds", available_now: bool = False,
) -> StreamingQuery:
    """Endless drain to one folder per topic, a file set per interval."""
    writer = (
        bus.stream(spark, topics, "earliest").writeStream.format("json")
        .option("checkpointLocation", checkpoint).option("path", out).partitionBy("topic")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": save_interval}
    return writer.trigger(**trigger).start()


def on_batch(
    stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand each micro-batch, a DataFrame, to a user function."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(**trigger).start()
