"""Weighted blends of collaborative and content scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.operators.content import content_candidates, similar_products
from shelfwise.operators.interactions import PAIR, enrich
from shelfwise.operators.neighbours import knn_recommend
from shelfwise.operators.ranking import top_n
from shelfwise.operators.skew import join_counted
from shelfwise.session import cut_lineage

# Weights of the two sources in the blend.
CF_WEIGHT, CB_WEIGHT = 0.7, 0.3

# Weightings compared by the sweep, as (cf, mf, cb).
SWEEP_WEIGHTS = (
    (0.3, 0.3, 0.4), (0.4, 0.3, 0.3), (0.3, 0.4, 0.3),
    (0.5, 0.25, 0.25), (0.25, 0.5, 0.25), (0.25, 0.25, 0.5),
    (0.6, 0.2, 0.2), (0.2, 0.6, 0.2), (0.2, 0.2, 0.6),
)


def max_normalise(scores: DataFrame, score: str) -> DataFrame:
    """Divide by the user's largest score; 0 where that is not positive. Pass a stored table where scores are costly."""
    largest = cut_lineage(scores.groupBy("user_id").agg(F.max(score).alias("_largest"), F.count(F.lit(1)).alias("_n")))
    share = F.when(F.col("_largest") > 0, F.col(score) / F.col("_largest")).otherwise(0.0)
    return join_counted(scores, largest, "user_id").withColumn(score, share).select(*scores.columns)


def merge_candidates(cb: DataFrame, cf: DataFrame) -> DataFrame:
    """Candidates of either source; the missing score is 0."""
    return cb.select(*PAIR, "cb_score").join(cf.select(*PAIR, "cf_score"), PAIR, "full").na.fill(
        0.0, ["cb_score", "cf_score"]
    )


def merge_scores(*scores: DataFrame) -> DataFrame:
    """Candidates of any source, each ``(user_id, product_id, <name>_score)``; missing scores are 0.

    The sources are put below one another and combined by pair, in one shuffle.
    """
    columns = [next(c for c in df.columns if c not in PAIR) for df in scores]
    rows = [df.select(*PAIR, *(F.col(c) if c == own else F.lit(None).cast("double").alias(c) for c in columns)) for df, own in zip(scores, columns, strict=True)]
    merged = reduce(DataFrame.unionByName, rows).groupBy(*PAIR).agg(*(F.max(c).alias(c) for c in columns))
    return merged.na.fill(0.0, columns)


def _flagged(behavior: DataFrame, cb: DataFrame, cf: DataFrame) -> DataFrame:
    """``(user_id, product_id, cb_score, cf_score, seen)``: candidates of either source, and whether the user touched them.

    Content candidates, by far the most rows, come grouped by pair; left joins by pair keep them where they are.
    """
    seen = behavior.select(*PAIR).distinct().withColumn("seen", F.lit(True))
    matched = cut_lineage(cb.join(cf, PAIR, "left").join(seen, PAIR, "left"))
    alone = cf.join(matched.where("cf_score IS NOT NULL"), PAIR, "left_anti").join(seen, PAIR, "left")
    rows = matched.unionByName(cut_lineage(alone.withColumn("cb_score", F.lit(None).cast("double"))))
    return rows.withColumn("seen", F.coalesce("seen", F.lit(False)))


def hybrid_blend(
    behavior: DataFrame,
    products: DataFrame,
    cb: DataFrame,
    cf: DataFrame,
    n: int = 10,
    cf_weight: float = CF_WEIGHT,
    cb_weight: float = CB_WEIGHT,
) -> DataFrame:
    """Normalise per source, blend, drop what the user touched, keep n, then attach products."""
    rows = _flagged(behavior, cb.select(*PAIR, "cb_score"), cut_lineage(cf.select(*PAIR, "cf_score")))
    largest = cut_lineage(rows.groupBy("user_id").agg(
        F.max("cb_score").alias("_cb"), F.max("cf_score").alias("_cf"), F.count(F.lit(1)).alias("_n")))
    merged = join_counted(rows.where("NOT seen").drop("seen"), largest, "user_id").select(*PAIR, *(
        F.when(F.col(most) > 0, F.coalesce(score, F.lit(0.0)) / F.col(most)).otherwise(0.0).alias(score)
        for score, most in (("cb_score", "_cb"), ("cf_score", "_cf"))))
    blended = merged.withColumn("hybrid_score", cf_weight * F.col("cf_score") + cb_weight * F.col("cb_score"))
    best = cut_lineage(top_n(blended, "user_id", "hybrid_score", "product_id", n).drop("rank"))
    return enrich(best, products).withColumn(
        "recommendation_score", C.recommendation_score("hybrid_score", "popularity_score")
    )


def hybrid_all_users(
    behavior: DataFrame, products: DataFrame, catalog: DataFrame | None = None, n: int = 10
) -> DataFrame:
    """The whole chain for every user at once: neighbours, similar products, blend."""
    behavior = cut_lineage(behavior)
    cf = knn_recommend(behavior, n=n).select(*PAIR, "cf_score")
    touched = behavior.select("product_id").distinct()
    similar = similar_products(products if catalog is None else catalog, touched, n)
    return hybrid_blend(behavior, products, content_candidates(behavior, similar), cf, n)


def blend_sweep(
    scores: DataFrame, weightings: Sequence[Mapping[str, float]], n: int = 10
) -> DataFrame:
    """Top n per user and weighting over columns of scores; the grid is a literal array."""
    settings = F.array(*[
        F.struct(
            F.lit(i).alias("setting"),
            sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0)).alias("blend"),
        )
        for i, weights in enumerate(weightings)
    ])
    rows = scores.select(*PAIR, F.inline(settings))
    return top_n(rows, ["setting", "user_id"], "blend", "product_id", n)
