"""Similar products by the words that describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.operators.ranking import top_n
from shelfwise.operators.similarity import SHORT_LIST, top_k_of_classes
from shelfwise.operators.text import distinct_texts, tfidf
from shelfwise.session import cut_lineage


def product_vectors(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(classes, vectors)``: products with equal descriptions, one unit TF-IDF vector for each."""
    described = products.select(
        "product_id",
        C.product_features("name", "brand", "category", "description").alias("features"),
    )
    texts, members = distinct_texts(described, "product_id", "features")
    return members, tfidf(texts, "class", "features", copies="copies")


def similar_products(
    products: DataFrame, wanted: DataFrame, n: int = 10, short_list: int = SHORT_LIST
) -> DataFrame:
    """``(product_id, similar_id, similarity, rank)`` for the wanted products only."""
    queries = wanted.select(F.col("product_id").alias("id")).distinct()
    classes, vectors = product_vectors(products)
    pairs = top_k_of_classes(queries, cut_lineage(classes), cut_lineage(vectors), n, short_list)
    named = pairs.select(
        F.col("qid").alias("product_id"), F.col("vid").alias("similar_id"), F.col("sim").alias("similarity")
    )
    return top_n(named, "product_id", "similarity", "similar_id", n)


def content_candidates(behavior: DataFrame, similar: DataFrame) -> DataFrame:
    """Per user, the products similar to any it touched, at their best similarity."""
    return (
        behavior.select("user_id", "product_id").join(similar, "product_id")
        .groupBy("user_id", F.col("similar_id").alias("product_id"))
        .agg(F.max("similarity").alias("cb_score"))
    )
