"""A stored text index of postings in blocks, and top lists that read few of them.

Documents are numbered in the order in which results are wanted (most popular first), so
postings sorted by number are sorted by priority too. A block holds up to ``BLOCK`` postings
of one term and field within one range of ``RANGE`` numbers: gaps between numbers, term
frequencies (none if all are one), lengths and priorities (none if all are equal), beside its
highest and lowest priority, the words it stands for, its greatest term frequency and its
greatest share of a term in a text. The last two bound its term weights whatever the mean
length will be, so texts are cut once. Blocks are cut where the documents lie and shuffled by
bucket and ``SPREAD`` numbers: a hot term spreads over as many tasks and files as documents fill.

Top lists first look at the small columns of the wanted terms' blocks, derive a bound from
them, and read only blocks that can reach it:

* by priority: any term's best blocks prove that ``size`` matches at some priority exist;
* by relevance: the ranges with the highest possible scores are scored first; their
  ``size``-th best score rules out the other ranges (block-max pruning).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.ids import ordinal_ids
from shelfwise.operators.search import K1, B, has_token, term_bucket, tokens

BLOCK, RANGE, BUCKETS = 128, 4096, 64
#: Ranges that are scored before the others are ruled out.
SEEDS = 8
#: Documents whose blocks of one bucket go to one task and file; blocks that a task hands to Spark at once.
SPREAD, ROWS = 64 * RANGE, 10_000
LOWEST = float("-inf")
SCHEMA = ("field string, term string, bucket int, range long, first long, n int, gaps array<int>, tfs array<int>, lengths array<int>, "
          "priorities array<double>, high double, low double, words long, most int, density double")
#: Blocks as they are cut; the bucket, a folder of the stored table, follows.
CUT = SCHEMA.replace("bucket int, ", "")


@dataclass
class TextIndex:
    """Folders of an index and the numbers that every score needs."""

    spark: SparkSession
    path: str
    fields: Mapping[str, float]
    documents: int
    mean_length: Mapping[str, float]
    filled: Mapping[str, int]
    docs_schema: T.StructType

    def blocks(self, terms: Sequence[str]) -> DataFrame:
        """Blocks of the wanted terms; only their buckets are read, and of these the row groups that may hold them."""
        wanted = self.spark.range(1).select(F.array_distinct(F.array(*[term_bucket(F.lit(t), BUCKETS) for t in terms])).alias("b")).first()["b"]
        table = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/postings")
        return table.where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))

    def docs(self) -> DataFrame:
        return self.spark.read.schema(self.docs_schema).parquet(f"{self.path}/docs")


def _cut(fields: Sequence[str], span: int):
    """Documents' words to blocks, one batch of documents at a time; a block spans at most ``span`` numbers."""

    def lists(values: np.ndarray, n: np.ndarray, kind: pa.DataType, kept: np.ndarray | None = None) -> pa.ListArray:
        if kept is not None:
            values, n = values[np.repeat(kept, n)], np.where(kept, n, 0)
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(values, kind))

    def blocks(batch: pa.RecordBatch, field: str) -> pa.RecordBatch | None:
        docs, words = batch.num_rows, batch[field]
        order = np.argsort(batch["number"].to_numpy())
        numbers, priorities = batch["number"].to_numpy()[order], batch["priority"].to_numpy()[order]
        sizes = words.value_lengths().to_numpy()
        terms = words.flatten().dictionary_encode()
        if not len(terms):
            return None
        # Equal words of a document stand together once sorted by word and place of the document.
        keys = terms.indices.to_numpy().astype(np.int64) * docs + np.repeat(np.argsort(order), sizes)
        keys.sort()
        start = np.flatnonzero(np.diff(keys, prepend=-1))
        code, at = np.divmod(keys[start], docs)
        tfs, number = np.diff(start, append=len(keys)), numbers[at]
        part = number // span
        new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        within = np.arange(len(at)) - np.repeat(new, np.diff(new, append=len(at)))
        first = np.flatnonzero(within % BLOCK == 0)
        n = np.diff(first, append=len(at))
        levels, lengths = priorities[at], sizes[order][at]
        high, low, most = np.maximum.reduceat(levels, first), np.minimum.reduceat(levels, first), np.maximum.reduceat(tfs, first)
        columns = {
            "field": pa.array([field]).take(pa.array(np.zeros(len(first), np.int32))), "term": terms.dictionary.take(pa.array(code[first])),
            "range": part[first], "first": number[first], "n": n.astype(np.int32),
            "gaps": lists(np.delete(np.diff(number, prepend=0), first), n - 1, pa.int32()), "tfs": lists(tfs, n, pa.int32(), most > 1),
            "lengths": lists(lengths, n, pa.int32()), "priorities": lists(levels, n, pa.float64(), high > low), "high": high, "low": low,
            "words": np.add.reduceat(tfs, first), "most": most.astype(np.int32), "density": np.maximum.reduceat(tfs / lengths, first)}
        return pa.RecordBatch.from_pydict(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in fields:
                out = blocks(batch, field)
                for at in range(0, out.num_rows if out else 0, ROWS):
                    yield out.slice(at, ROWS)

    return cut


def sorted_blocks(words: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(number, priority, words of each field)`` to blocks by bucket.

    Words are cut once, where the documents lie: a task sends blocks on, no words and no postings.
    """
    keys = ["bucket", "field", "term", "first"]
    return (
        words.mapInArrow(_cut(fields, RANGE), CUT).withColumn("bucket", term_bucket(F.col("term"), BUCKETS))
        .repartition("bucket", F.floor(F.col("first") / SPREAD)).sortWithinPartitions(*keys)
    )


def build(df: DataFrame, fields: Mapping[str, float], path: str, order: Sequence[Column], priority: str | None = None) -> TextIndex:
    """Write the index of the given fields; ``order`` numbers the documents and must start with ``priority``, greatest first."""
    spark = df.sparkSession
    level = F.coalesce(F.col(priority).cast("double"), F.lit(LOWEST)) if priority else F.lit(0.0)
    numbered = ordinal_ids(df, list(order), "_number")
    numbered.sortWithinPartitions("_number").write.mode("overwrite").parquet(f"{path}/docs")
    docs_schema = numbered.schema
    numbered = spark.read.schema(docs_schema).parquet(f"{path}/docs")
    words = numbered.select(F.col("_number").alias("number"), level.alias("priority"), *(tokens(f).alias(f) for f in fields))
    sorted_blocks(words, list(fields)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(SCHEMA).parquet(f"{path}/postings")
    total = {r["field"]: r["words"] for r in stored.groupBy("field").agg(F.sum("words").alias("words")).collect()}
    counts = numbered.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(has_token(f)).alias(f"n_{f}") for f in fields)).first()
    filled = {f: counts[f"n_{f}"] for f in fields}
    mean = {f: total.get(f, 0) / filled[f] if filled[f] else 1.0 for f in fields}
    return TextIndex(spark, path, dict(fields), counts["n"], mean, filled, docs_schema)


def _postings(blocks: DataFrame) -> DataFrame:
    """Blocks to ``(field, term, number, tf, length, priority)``."""
    # Gaps to numbers: each is the last one so far plus its gap.
    numbers = F.aggregate("gaps", F.array("first"), lambda a, gap: F.concat(a, F.array(F.element_at(a, -1) + gap)))
    zipped = F.arrays_zip(numbers.alias("number"), F.col("tfs"), F.col("lengths"), F.col("priorities"))
    rows = blocks.select("field", "term", "high", F.inline(zipped)).toDF("field", "term", "high", "number", "tf", "length", "priority")
    return rows.select(
        "field", "term", "number", F.coalesce("tf", F.lit(1)).alias("tf"), "length", F.coalesce("priority", "high").alias("priority"))


def _idf(index: TextIndex, terms: Sequence[str], frequencies: DataFrame) -> dict[tuple[str, str], float]:
    """idf of each wanted field and term: a few rows."""
    out = {}
    for field, term, df in frequencies.groupBy("field", "term").agg(F.sum("n")).collect():
        out[field, term] = math.log(1 + (index.filled[field] - df + 0.5) / (df + 0.5))
    return out


def _scored(index: TextIndex, postings: DataFrame, idf: Mapping[tuple[str, str], float]) -> DataFrame:
    """``(number, priority, relevance)``: the best boosted field score of every matching document."""
    facts = F.create_map(*(x for (field, term), v in idf.items() for x in (F.lit(f"{field}\n{term}"), F.lit(v))))
    means = F.create_map(*(x for f in index.fields for x in (F.lit(f), F.lit(index.mean_length[f]))))
    boosts = F.create_map(*(x for f, b in index.fields.items() for x in (F.lit(f), F.lit(b))))
    length = 1 - B + B * F.col("length") / means[F.col("field")]
    part = facts[F.concat_ws("\n", "field", "term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    by_field = postings.groupBy("number", "priority", "field").agg(F.sum(part).alias("s"))
    return by_field.groupBy("number", "priority").agg(F.max(boosts[F.col("field")] * F.col("s")).alias("relevance"))


def scored(index: TextIndex, terms: Sequence[str]) -> DataFrame:
    """Every matching document with its relevance: reads all blocks of the terms and no document."""
    blocks = index.blocks(terms)
    idf = _idf(index, terms, blocks)
    return _scored(index, _postings(blocks), idf or {("", ""): 0.0})


def _with_documents(index: TextIndex, best: DataFrame) -> DataFrame:
    """Attach the documents of a top list; their numbers, a few, reach the scan as a filter."""
    rows = best.collect()
    table = index.spark.createDataFrame([tuple(r) for r in rows], "_number long, _priority double, relevance double")
    docs = index.docs().where(F.col("_number").isin([r[0] for r in rows]))
    return docs.join(F.broadcast(table.drop("_priority")), "_number")


def wanted_by_priority(index: TextIndex, terms: Sequence[str], size: int) -> tuple[DataFrame, DataFrame]:
    """(all blocks of the terms, those that can hold one of the ``size`` best by priority)."""
    blocks = index.blocks(terms)
    best = W.partitionBy("field", "term").orderBy(F.desc("low"))
    proof = (
        blocks.select("field", "term", "low", "n").withColumn("r", F.row_number().over(best)).where(F.col("r") <= size)
        .withColumn("so_far", F.sum("n").over(best.rowsBetween(W.unboundedPreceding, 0))).where(F.col("so_far") >= size)
    )
    bound = proof.agg(F.max("low")).first()[0]
    return blocks, blocks if bound is None else blocks.where(F.col("high") >= bound)


def top_by_priority(index: TextIndex, terms: Sequence[str], size: int = 10) -> DataFrame:
    """Documents with any term: greatest priority first, then relevance at nine decimals, then number."""
    blocks, wanted = wanted_by_priority(index, terms, size)
    idf = _idf(index, terms, blocks.select("field", "term", "n"))
    if not idf:
        return index.docs().limit(0).withColumn("relevance", F.lit(0.0)).drop("_number")
    best = _scored(index, _postings(wanted), idf).orderBy(F.desc("priority"), F.round("relevance", 9).desc(), "number").limit(size)
    return _with_documents(index, best).drop("_number")


def wanted_by_relevance(index: TextIndex, terms: Sequence[str], size: int, seeds: int = SEEDS) -> tuple[DataFrame, dict, DataFrame]:
    """(blocks that can hold one of the ``size`` most relevant, idf, all blocks)."""
    blocks = index.blocks(terms)
    idf = _idf(index, terms, blocks.select("field", "term", "n"))
    if not idf:
        return blocks, idf, blocks
    facts = F.create_map(*(x for (field, term), v in idf.items() for x in (F.lit(f"{field}\n{term}"), F.lit(v * index.fields[field]))))
    means = F.create_map(*(x for f in index.fields for x in (F.lit(f), F.lit(index.mean_length[f]))))
    # A weight grows with the frequency and with the share of the text, so their maxima bound it; of one posting it is the weight.
    weight = (K1 + 1) / (1 + K1 * (1 - B) / F.col("most") + K1 * B / (means[F.col("field")] * F.col("density")))
    most = blocks.groupBy("range", "field", "term").agg(F.max(weight).alias("w")).withColumn("w", F.col("w") * facts[F.concat_ws("\n", "field", "term")])
    # A document's score is that of one field; margins cover the order of sums.
    bounds = most.groupBy("range", "field").agg(F.sum("w").alias("s")).groupBy("range").agg((F.max("s") * (1 + 1e-9) + 1e-9).alias("bound"))
    first = [r[0] for r in bounds.orderBy(F.desc("bound"), "range").limit(seeds).collect()]
    seeded = _scored(index, _postings(blocks.where(F.col("range").isin(first))), idf)
    kth = seeded.orderBy(F.desc("relevance")).limit(size).agg(F.count(F.lit(1)), F.min("relevance")).first()
    if kth[0] < size:
        return blocks, idf, blocks
    reach = bounds.where(F.col("bound") >= kth[1] - 1e-8).select("range")
    return blocks.join(reach, "range", "left_semi"), idf, blocks


def top_by_relevance(index: TextIndex, terms: Sequence[str], size: int = 10, seeds: int = SEEDS) -> DataFrame:
    """The most relevant documents, ties by number."""
    wanted, idf, _ = wanted_by_relevance(index, terms, size, seeds)
    if not idf:
        return index.docs().limit(0).withColumn("relevance", F.lit(0.0)).drop("_number")
    best = _scored(index, _postings(wanted), idf).orderBy(F.round("relevance", 9).desc(), "number").limit(size)
    return _with_documents(index, best).drop("_number")
