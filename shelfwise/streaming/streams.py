"""Streams of products, reviews and behaviour: typed, stamped and scored as they arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from shelfwise.functions import columns as C
from shelfwise.functions.messages import parse_message, stamp_if_missing
from shelfwise.schemas import RAW, RAW_EVENT, RAW_PRODUCT, RAW_REVIEW


@dataclass(frozen=True)
class StreamSettings:
    """A batch every ten seconds, at most 100 records per second and partition."""

    interval: str = "10 seconds"
    interval_seconds: int = 10
    records_per_second: int = 100
    max_files: int = 1000

    def broker_limits(self, partitions: int) -> dict[str, str]:
        return {"maxOffsetsPerTrigger": str(self.records_per_second * self.interval_seconds * partitions)}

    def file_limits(self) -> dict[str, str]:
        return {"maxFilesPerTrigger": str(self.max_files)}

    def trigger(self, available_now: bool = False) -> dict[str, object]:
        return {"availableNow": True} if available_now else {"processingTime": self.interval}


def file_stream(spark: SparkSession, data_type: str, path: str, settings: StreamSettings = StreamSettings()) -> DataFrame:
    """New JSON files of a folder under the declared schema."""
    return spark.readStream.schema(RAW[data_type]).options(**settings.file_limits()).json(path)


def product_stream(messages: DataFrame, as_of: Column | None = None) -> DataFrame:
    return stamp_if_missing(_typed(messages, RAW_PRODUCT), as_of=as_of)


def review_stream(messages: DataFrame, as_of: Column | None = None) -> DataFrame:
    rows = stamp_if_missing(_typed(messages, RAW_REVIEW), as_of=as_of)
    return rows.withColumn("sentiment_score", C.sentiment_score("rating"))


def behavior_stream(messages: DataFrame, as_of: Column | None = None) -> DataFrame:
    rows = stamp_if_missing(_typed(messages, RAW_EVENT), as_of=as_of)
    return rows.withColumn("action_weight", C.action_weight("action"))


def _typed(messages: DataFrame, schema) -> DataFrame:
    """Messages carry JSON in ``value``; file streams are typed already."""
    if "value" not in messages.columns:
        return messages
    keep = [c for c in messages.columns if c not in ("key", "topic")]
    return parse_message(messages.select(*keep), schema)


def start_append(
    stream: DataFrame, path: str, checkpoint: str, settings: StreamSettings = StreamSettings(),
    available_now: bool = False, fmt: str = "json", **options: str,
) -> StreamingQuery:
    """Append to files; the checkpoint makes a restart neither lose nor repeat rows. ``options`` go to the writer."""
    return (
        stream.writeStream.format(fmt).options(**options).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**settings.trigger(available_now)).start()
    )
