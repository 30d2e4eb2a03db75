"""The corpus pipeline: toxicity, near-duplicates, contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame; ``run`` writes each result as Parquet to the shared folder and rereads it as
the next stage's documents, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import load, stored
from shelfwise.llm.decontamination import contamination
from shelfwise.llm.packing import packed
from shelfwise.llm.pii import redact
from shelfwise.llm.simhash import deduplicated
from shelfwise.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity(docs, load(spark, sf_dir, "labels")).where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows contaminate go; the others stay as they are."""
    return contamination(docs, load(spark, sf_dir, "benchmark")).where("NOT contaminated").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a training sequence."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data), ("packing", pack_sequences),
]
#: The stages tokenise, hash to bits and follow links; SQL cannot express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
