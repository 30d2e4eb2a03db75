"""TF-IDF vectors over documents of any size, as joins and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.stop_words import ENGLISH
from shelfwise.operators.skew import join_counted

#: Characters of text whose terms one task counts.
TASK_CHARS = 4_000_000
WORD = r"([\p{L}\p{N}_]{2,})"


def words(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two or more characters, stop words removed, as an array."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(stop_words))


def spread_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, text)`` spread by id over as many tasks as the texts fill with ``TASK_CHARS`` characters.

    What a task counts per id and term is many times its texts, so it must not grow with the table, as it
    does where shuffled bytes decide how many partitions are joined into one task.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.repartition(_tasks(rows), "id")


def _tasks(rows: DataFrame) -> int:
    return 1 + (rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // TASK_CHARS


def block_labels(spark: SparkSession, n: int) -> DataFrame:
    """``(slot, block)``: for each of n slots a number that hashes to the partition of that place, one number a partition."""
    tried = spark.range(int(n * (20 + math.log(n)))).withColumnRenamed("id", "block")
    return tried.groupBy(F.pmod(F.hash("block"), F.lit(n)).alias("slot")).agg(F.min("block").alias("block"))


def counted_terms(texts: DataFrame, stop_words: list[str]) -> DataFrame:
    """The columns of ``texts`` before ``text`` and each of its terms, single words and adjacent pairs, with their number ``tf``.

    Nothing is shuffled where the rows are partitioned by some of these columns.
    """
    keys = [c for c in texts.columns if c != "text"]
    tokens = texts.select(*keys, words(F.col("text"), stop_words).alias("t"))
    size = F.size("t")
    pairs = F.zip_with(
        F.slice("t", 1, F.greatest(size - 1, F.lit(0))), F.slice("t", 2, F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    terms = tokens.select(*keys, F.explode(F.concat("t", pairs)).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(docs: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """``(id, term, tf)`` with single words and adjacent pairs.

    Whole texts are spread by id before they are cut: a text is smaller than its
    terms, and counting per id and term then needs no second shuffle.
    """
    return counted_terms(spread_texts(docs, key, text), ENGLISH if stop_words is None else stop_words)


def vocabulary(counts: DataFrame, copies: str | None = None, limit: int | None = None) -> DataFrame:
    """``(term, df)`` of all terms, or of the ``limit`` most frequent in the corpus; ties broken by term.

    ``copies`` names a column saying for how many equal documents a row stands.
    """
    weight = F.col(copies) if copies else F.lit(1)
    totals = counts.groupBy("term").agg(
        F.sum(F.col("tf") * weight).alias("total"), F.sum(weight).alias("df")
    )
    if limit is not None:
        totals = totals.orderBy(F.desc("total"), "term").limit(limit)
    return totals.select("term", "df")


def tfidf(
    docs: DataFrame, key: str, text: str, copies: str | None = None,
    stop_words: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """``(id, dim, w)`` unit vectors with idf = ln((1 + n) / (1 + df)) + 1.

    Whole texts are dealt to blocks and counted there, once for the document frequencies and once for the
    weights. No count is shuffled or stored: a block sends each of its terms once, whatever number of its texts
    has it, and gets back the frequency of those that other blocks have, too.
    """
    stop = ENGLISH if stop_words is None else stop_words
    rows = docs.select(
        F.col(key).alias("id"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"), F.col(text).alias("text"))
    tasks = _tasks(rows)
    labels = F.broadcast(block_labels(docs.sparkSession, tasks))  # one row a task
    dealt = rows.withColumn("slot", F.pmod(F.hash("id"), F.lit(tasks))).join(labels, "slot", "left")
    blocks = dealt.select(F.coalesce("block", "slot").alias("block"), "id", "copies", "text").repartition(tasks, "block")
    counts = counted_terms(blocks, stop)
    n = docs.agg(F.sum(copies) if copies else F.count(F.lit(1))).scalar()
    idf = F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1
    if limit is not None:
        known = counts.join(F.broadcast(vocabulary(counts, "copies", limit)), "term")
    else:
        known = _with_frequencies(counts, tasks)
    weighted = known.select("block", "id", F.col("term").alias("dim"), (F.col("tf") * idf).alias("x"))
    # A document's weights meet once, for its norm and for their division by it; its terms fit a task, as its text does.
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("id", "block")))
    return weighted.select("id", "dim", (F.col("x") / norm).alias("w"))


def _with_frequencies(counts: DataFrame, tasks: int) -> DataFrame:
    """The counts with ``df``, the documents of all blocks that have the term."""
    of_block = counts.groupBy("block", "term").agg(F.sum("copies").alias("here"))
    everywhere = of_block.withColumn("everywhere", F.sum("here").over(W.partitionBy("term")))  # a term has one row a block
    returned = everywhere.where("everywhere > here").select("block", "term", "everywhere").repartition(tasks, "block")
    # Both sides lie in partitions of whole blocks, so that their union does and nothing is shuffled after it.
    # Sorted by a hash first: numbers are compared faster than words.
    own = W.partitionBy("hash", "term", "block")
    met = counts.unionByName(returned, allowMissingColumns=True).withColumn("hash", F.xxhash64("term"))
    met = met.withColumn("df", F.coalesce(F.max("everywhere").over(own), F.sum("copies").over(own)))
    return met.where("tf IS NOT NULL").drop("everywhere", "hash")


def distinct_texts(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(texts, members)``: equal texts merged under their smallest key, with their number.

    Grouping is by text, combined map-side; members maps each key to its representative.
    """
    texts = docs.groupBy(text).agg(F.min(key).alias("class"), F.count(F.lit(1)).alias("copies"))
    members = join_counted(docs.select(F.col(key).alias("id"), text), texts.withColumn("_n", F.col("copies")), text).select("id", "class")
    return texts, members
