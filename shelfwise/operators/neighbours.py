"""Nearest users and the recommendations drawn from them, for all users in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.interactions import PAIR, exclude_seen
from shelfwise.operators.ranking import top_n
from shelfwise.operators.shared import shared_dims
from shelfwise.operators.short_lists import nearest_of_all
from shelfwise.operators.similarity import CELLS_PER_PAIR, HEAVY, SHORT_LIST, profile_classes, top_k_of_classes, unit_vectors
from shelfwise.session import cut_lineage

NEIGHBOURS = 10


def user_vectors(behavior: DataFrame) -> DataFrame:
    return unit_vectors(behavior, "user_id", "product_id", "interaction_score")


def user_similarity(behavior: DataFrame, k: int = NEIGHBOURS, short_list: int = SHORT_LIST) -> DataFrame:
    """``(user_id, neighbour_id, similarity, rank)``: the k most similar users of every user.

    The behaviour is read several times: pass a checkpointed or stored table.
    """
    entries = behavior.select(F.col("user_id").alias("id"), F.col("product_id").alias("dim"), F.col("interaction_score").cast("double").alias("x"))
    found = nearest_of_all(entries.where("x != 0 AND id IS NOT NULL"), k, short_list, CELLS_PER_PAIR, HEAVY)
    if found is not None:
        return found.select(F.col("qid").alias("user_id"), F.col("vid").alias("neighbour_id"), F.col("sim").alias("similarity"), "rank")
    vectors = cut_lineage(user_vectors(behavior))
    classes = cut_lineage(profile_classes(vectors))
    distinct_vectors = cut_lineage(vectors.join(classes.where("id = class").select("id"), "id", "left_semi"))
    pairs = top_k_of_classes(classes, classes, distinct_vectors, k, short_list)
    named = pairs.select(
        F.col("qid").alias("user_id"), F.col("vid").alias("neighbour_id"), F.col("sim").alias("similarity")
    )
    return top_n(named, "user_id", "similarity", "neighbour_id", k)


def co_interaction(behavior: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """Products shared by a user and each of its neighbours; without neighbours, by all users that share any."""
    if neighbours is None:
        positive = behavior.where("interaction_score > 0").select(F.col("user_id").alias("id"), F.col("product_id").alias("dim"))
        names = (F.col("id").alias("user_id"), F.col("other").alias("neighbour_id"), F.col("shared").alias("shared_products"))
        return shared_dims(positive.distinct()).select(*names)
    profiles = behavior.where("interaction_score > 0").groupBy("user_id").agg(F.collect_set("product_id").alias("products"))
    mine = profiles.withColumnRenamed("products", "mine")
    both = neighbours.select("user_id", "neighbour_id").join(profiles.withColumnRenamed("user_id", "neighbour_id"), "neighbour_id").join(mine, "user_id")
    shared = F.size(F.array_intersect("mine", "products")).cast("long")
    return both.select("user_id", "neighbour_id", shared.alias("shared_products")).where("shared_products > 0")


def predicted_scores(behavior: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Similarity-weighted interactions of the neighbours with what the user has not scored yet."""
    theirs = behavior.where("interaction_score > 0").select(
        F.col("user_id").alias("neighbour_id"), "product_id", "interaction_score"
    )
    scores = (
        neighbours.join(theirs, "neighbour_id")
        .groupBy(*PAIR).agg(F.sum(F.col("similarity") * F.col("interaction_score")).alias("cf_score"))
        .where("cf_score > 0")
    )
    return exclude_seen(scores, behavior.where("interaction_score > 0"))


def knn_recommend(
    behavior: DataFrame, k: int = NEIGHBOURS, n: int = 10, short_list: int = SHORT_LIST
) -> DataFrame:
    """Top n products per user from the k nearest users; scored products are left out.

    The behaviour is read several times: pass a checkpointed or stored table.
    """
    scores = predicted_scores(behavior, user_similarity(behavior, k, short_list))
    return top_n(scores, "user_id", "cf_score", "product_id", n)


# The parameter grid of the neighbourhood sweep.
SWEEP_K = (5, 10, 20)
SWEEP_THRESHOLD = (0.2, 0.3, 0.4)


def knn_sweep(
    behavior: DataFrame,
    ks: Sequence[int] = SWEEP_K,
    thresholds: Sequence[float] = SWEEP_THRESHOLD,
    n: int = 10,
) -> DataFrame:
    """Mean list length per (k, threshold), all settings in one pass.

    Neighbours are ranked once for the largest k; each setting is a conditional sum
    over the same join, so the shuffle does not grow with the grid.
    """
    grid = [(k, t) for k in ks for t in thresholds]
    neighbours = user_similarity(behavior, max(ks))
    theirs = behavior.where("interaction_score > 0").select(
        F.col("user_id").alias("neighbour_id"), "product_id", "interaction_score"
    )
    product = F.col("similarity") * F.col("interaction_score")
    per_setting = [
        F.max((F.col("rank") <= k) & (F.round("similarity", 9) >= t) & (product > 0)).cast("int").alias(f"s{i}")
        for i, (k, t) in enumerate(grid)
    ]
    hits = exclude_seen(
        neighbours.join(theirs, "neighbour_id").groupBy(*PAIR).agg(*per_setting),
        behavior.where("interaction_score > 0"),
    )
    lengths = hits.groupBy("user_id").agg(
        *[F.least(F.sum(f"s{i}"), F.lit(n)).alias(f"s{i}") for i in range(len(grid))]
    )
    users = behavior.select("user_id").distinct()
    means = users.join(lengths, "user_id", "left").na.fill(0).agg(
        *[F.avg(f"s{i}").alias(f"s{i}") for i in range(len(grid))]
    )
    settings = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold"), F.col(f"s{i}").alias("avg_recommendations"))
        for i, (k, t) in enumerate(grid)
    ])
    return means.select(F.inline(settings))
