"""Joins with an aggregate over the join key, hot keys split.

Spark splits the partitions of a hot key only where both sides of a join are plain shuffles.
A side that was aggregated by the key has its partitioning already, so all rows of a hot key
meet it in one task. Here the aggregate's own counts name the hot keys: their rows are
dealt over ``SALTS`` places, to each of which a copy of the aggregate's one row goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, and from this share of all rows on: 1 / share keys at most.
HOT_ROWS, HOT_SHARE = 100_000, 1e-4
SALTS = 64


def join_counted(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], count: str = "_n", hot_rows: int = HOT_ROWS, salts: int = SALTS,
    how: str = "inner",
) -> DataFrame:
    """Join rows to ``right``, which has one row per key and, in ``count``, the number of rows of ``left`` with it.

    ``how`` is ``inner`` or ``left``. A row's place is a hash of the row, so a repeated task deals it alike.
    Rows that are costly to compute are better stored before: they are read for the counts, too.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    bound = F.greatest(F.lit(hot_rows), F.coalesce(right.agg(F.sum(count)).scalar() * HOT_SHARE, F.lit(0.0)))
    hot = right.where(F.col(count) >= bound).select(*keys, F.lit(True).alias("_hot"))  # 1 / HOT_SHARE rows at most
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col(count) >= bound, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(copies)).drop(count), [*keys, "_salt"], how).drop("_salt")


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """The same with any table that has one row per key, such as a catalogue; the rows of ``left`` are counted first."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    counted = right.join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return join_counted(left, counted, key, "_n", hot_rows, salts, how)
