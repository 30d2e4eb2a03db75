"""Alternating least squares on implicit feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.operators.ids import attach_indexes, deindex, index_ids
from shelfwise.operators.interactions import enrich
from shelfwise.operators.similarity import dense_top_k
from shelfwise.session import cut_lineage

# Model settings.
RANK, ITERATIONS, REGULARISATION, ALPHA, SEED = 10, 10, 0.1, 1.0, 42
TRAIN_PERCENT = 80
#: Least and most blocks of items, and the ratings that fill one.
ITEM_BLOCKS, BLOCK_RATINGS = (2, 10), 20_000_000


def train_test_split(df: DataFrame, keys: Sequence[str], percent: int = TRAIN_PERCENT, seed: int = SEED):
    """Hold-out by a hash of the keys: the same rows every time, also after a lost executor."""
    side = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(100))
    return split_by(df, side < percent)


def split_by(df: DataFrame, train: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(train), df.where(~train)


def indexed(behavior: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ratings, users, items)`` with dense integer ids, the maps kept as checkpoints."""
    users = cut_lineage(index_ids(behavior, "user_id", "user_index"))
    items = cut_lineage(index_ids(behavior, "product_id", "item_index"))
    ratings = attach_indexes(behavior, users, items).select(
        "user_index", "item_index", F.col("interaction_score").cast("float").alias("rating")
    )
    return ratings, users, items


def item_blocks(ratings: DataFrame) -> int:
    """As few blocks of items as their ratings allow.

    Each step sends the factors of a user to every block with one of the user's items, so to all blocks where users touch
    many items. A fit starts from the users' factors, whose blocks stay: its numbers do not depend on this.
    """
    least, most = ITEM_BLOCKS
    return min(most, max(least, -(-ratings.count() // BLOCK_RATINGS)))


def als(
    rank: int = RANK, iterations: int = ITERATIONS, regularisation: float = REGULARISATION, blocks: int = ITEM_BLOCKS[1]
) -> ALS:
    return ALS(
        rank=rank, maxIter=iterations, regParam=regularisation, alpha=ALPHA, implicitPrefs=True, numItemBlocks=blocks,
        userCol="user_index", itemCol="item_index", ratingCol="rating",
        coldStartStrategy="drop", seed=SEED, checkpointInterval=5,
    )


def als_fit(ratings: DataFrame, **settings) -> ALSModel:
    return als(blocks=item_blocks(ratings), **settings).fit(ratings)


def als_rmse(model: ALSModel, test: DataFrame) -> DataFrame:
    """Root mean squared error of the prediction against the raw score, as a one-row table."""
    predicted = model.transform(test)
    gap = F.col("prediction") - F.col("rating")
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def als_recommend_all(
    model: ALSModel, users: DataFrame, items: DataFrame, products: DataFrame, n: int = 10
) -> DataFrame:
    """Top n per user, original ids and product columns attached; seen products stay in.

    Factors are multiplied block against block under norm bounds, so no cross join is planned.
    """
    factors = [side.select("id", F.col("features").alias("ws")) for side in (model.userFactors, model.itemFactors)]
    best = dense_top_k(*factors, n)
    lists = best.select(
        F.col("qid").alias("user_index"), F.col("vid").alias("item_index"), F.col("sim").alias("cf_score")
    )
    return (
        enrich(cut_lineage(deindex(lists, users, items)), products)
        .withColumn("recommendation_score", C.recommendation_score("cf_score", "popularity_score"))
        .withColumn("algorithm", F.lit("als"))
    )


# The parameter grid of the factorisation sweep.
SWEEP_RANKS, SWEEP_ITERATIONS = (10, 20, 30), (20, 50)


def mf_sweep(
    ratings: DataFrame,
    ranks: Sequence[int] = SWEEP_RANKS,
    iterations: Sequence[int] = SWEEP_ITERATIONS,
    regularisations: Sequence[float] = (REGULARISATION,),
    parallelism: int = 6,
) -> TrainValidationSplitModel:
    """Fit the grid on 80 % and compare the settings on the rest; ``validationMetrics`` holds the errors."""
    model = als(blocks=item_blocks(ratings))
    grid = (
        ParamGridBuilder()
        .addGrid(model.rank, list(ranks))
        .addGrid(model.maxIter, list(iterations))
        .addGrid(model.regParam, list(regularisations))
        .build()
    )
    evaluator = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction")
    return TrainValidationSplit(
        estimator=model, estimatorParamMaps=grid, evaluator=evaluator, trainRatio=0.8, seed=SEED,
        parallelism=parallelism,
    ).fit(ratings)


def sweep_table(fitted: TrainValidationSplitModel, like: DataFrame) -> DataFrame:
    """One row per setting of the (fixed-size) grid with its validation error."""
    rows = []
    for params, error in zip(fitted.getEstimatorParamMaps(), fitted.validationMetrics):
        named = {p.name: v for p, v in params.items()}
        rows.append((int(named["rank"]), int(named["maxIter"]), float(named["regParam"]), float(error)))
    return like.sparkSession.createDataFrame(rows, "rank int, iterations int, regularisation double, rmse double")
