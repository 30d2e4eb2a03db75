"""Ranked text search over product fields and documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.text import spread_texts

# BM25 parameters and the boosts of the searched fields.
K1, B = 1.2, 0.75
PRODUCT_FIELDS = {"name": 3.0, "location": 1.0}
NOT_WORD, WORD_CHARACTER = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def has_token(text: str) -> Column:
    """Whether a text has any token; it is read up to the first."""
    return F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(WORD_CHARACTER)


def query_terms(df: DataFrame, text: str) -> list[str]:
    """Distinct tokens of a query string, cut by the same expression as the documents."""
    row = df.sparkSession.range(1).select(F.array_distinct(tokens(F.lit(text))).alias("t")).first()
    return row["t"]


def bm25_statistics(df: DataFrame, fields: Mapping[str, float], terms: Sequence[str]) -> Column:
    """Documents, summed lengths and term frequencies per field, as one scalar struct.

    They come from one aggregate over the whole table: nothing is joined or exploded.
    """
    cut = df.select(*[tokens(name).alias(name) for name in fields])
    parts = []
    for name in fields:
        size = F.size(name)
        parts += [F.count_if(size > 0).alias(f"{name}_n"), F.sum(size).alias(f"{name}_len")]
        parts += [F.count_if(F.array_contains(name, t)).alias(f"{name}_df{i}") for i, t in enumerate(terms)]
    totals = cut.agg(*parts)
    return totals.select(F.struct(*totals.columns)).scalar()


def bm25(words: Mapping[str, Column], fields: Mapping[str, float], terms: Sequence[str], stats: Column) -> Column:
    """Best boosted field score of a row from the token arrays of its fields."""
    def field_score(name: str) -> Column:
        docs = stats.getField(f"{name}_n")
        mean = stats.getField(f"{name}_len") / docs
        length = 1 - B + B * F.size(words[name]) / mean
        total = F.lit(0.0)
        for i, term in enumerate(terms):
            tf = F.size(F.filter(words[name], _equals(term)))
            df_t = stats.getField(f"{name}_df{i}")
            idf = F.log(1 + (docs - df_t + 0.5) / (df_t + 0.5))
            total = total + idf * tf * (K1 + 1) / (tf + K1 * length)
        return F.when(F.size(words[name]) > 0, total).otherwise(0.0)

    scores = [F.lit(boost) * field_score(name) for name, boost in fields.items()]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def _equals(term: str):
    return lambda word: word == term


def scored_matches(df: DataFrame, text: str, fields: Mapping[str, float]) -> DataFrame:
    """Rows holding any query token, with their relevance."""
    terms = query_terms(df, text)
    if not terms:
        return df.limit(0).withColumn("relevance", F.lit(0.0))
    words = {name: F.col(f"_{name}_words") for name in fields}
    cut = df.withColumns({f"_{name}_words": tokens(name) for name in fields})
    wanted = F.array(*[F.lit(t) for t in terms])
    hit = reduce(lambda a, b: a | b, [F.arrays_overlap(w, wanted) for w in words.values()])
    scored = cut.where(hit).withColumn("relevance", bm25(words, fields, terms, bm25_statistics(df, fields, terms)))
    return scored.select(*df.columns, "relevance")


def search_products(products: DataFrame, text: str, size: int = 10) -> DataFrame:
    """Popularity decides the order; relevance only breaks ties."""
    return (
        scored_matches(products, text, PRODUCT_FIELDS)
        .orderBy(F.desc_nulls_last("popularity_score"), F.round("relevance", 9).desc(), "product_id")
        .limit(size)
    )


def term_lookup(df: DataFrame, field: str, value, sort: Sequence[Column], size: int = 10) -> DataFrame:
    """Exact keyword filter with a sort list."""
    return df.where(F.col(field) == F.lit(value)).orderBy(*sort).limit(size)


def build_inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, id, tf, first_position)``; a hot term stays many rows, never one list.

    Whole texts are spread by id first, so that counting per term and id stays in place.
    """
    spread = spread_texts(docs, key, text)
    positions = spread.select("id", F.posexplode(tokens("text")).alias("position", "term"))
    return positions.groupBy("term", "id").agg(
        F.count(F.lit(1)).alias("tf"), F.min("position").alias("first_position")
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")
    )


def write_inverted_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Store the postings by term bucket, sorted by term, so that a lookup reads one folder.

    The range sort cuts by size: a hot term fills as many tasks and files as it needs.
    """
    keys = ["bucket", "term", "id"]
    (
        postings.withColumn("bucket", term_bucket(F.col("term"), buckets))
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.mode("overwrite").partitionBy("bucket").parquet(path)
    )


def term_bucket(term: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_postings(spark, path: str, terms: Sequence[str], buckets: int = 64) -> DataFrame:
    """Postings of the given terms; only their buckets are read."""
    wanted = spark.range(1).select(
        F.array_distinct(F.array(*[term_bucket(F.lit(t), buckets) for t in terms])).alias("b")
    ).first()["b"]
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))
