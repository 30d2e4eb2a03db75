"""Exact grouped percentiles in three scans that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 4096
#: The sketch's accuracy, and how far beside the wanted share its bracket reaches.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY


def bracket(value: Column, fraction: float) -> list[Column]:
    """Aggregates that tell roughly where a percentile lies: ``_n`` values, and ``_near`` as its interval."""
    near = [max(0.0, fraction - MARGIN), min(1.0, fraction + MARGIN)]
    return [F.count(value).alias("_n"), F.percentile_approx(value.cast("double"), near, ACCURACY).alias("_near")]


def percentile_within(df: DataFrame, brackets: DataFrame, group: str, value: Column, fraction: float, name: str) -> DataFrame:
    """Linear-interpolation percentile per group, given the groups' brackets.

    The bracket is cut into equal cells, with one more on each side for all that lies outside.
    The cells are counted with a map-side combine, and only those that hold the wanted ranks
    are ordered, as counts of distinct values. The result is exact however good the bracket is.
    """
    rows = df.select(F.col(group).alias("g"), value.cast("double").alias("v")).where("v is not null")
    position = (F.col("_n") - 1) * F.lit(fraction)
    state = brackets.where("_n > 0").select(
        F.col(group).alias("g"), F.col("_near")[0].alias("lo"), F.col("_near")[1].alias("hi"),
        position.alias("pos"), F.floor(position).alias("r0"), F.ceil(position).alias("r1"))
    width = (F.col("hi") - F.col("lo")) / CELLS
    inside = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(CELLS - 1))).otherwise(0)
    cell = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), CELLS).otherwise(inside)
    known = [F.first(c).alias(c) for c in ("pos", "r0", "r1")]
    counts = rows.join(state, "g").groupBy("g", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("cell_lo"), F.max("v").alias("cell_hi"), *known)
    upto = F.sum("c").over(W.partitionBy("g").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    spans = counts.withColumn("end", upto).withColumn("start", F.col("end") - F.col("c"))
    wanted = spans.where((F.col("end") > F.col("r0")) & (F.col("start") <= F.col("r1"))).groupBy("g").agg(
        F.min("cell_lo").alias("lo"), F.max("cell_hi").alias("hi"), F.min("start").alias("below"), *known)
    values = rows.join(wanted, "g").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("c"), F.first("below").alias("below"), *known)
    upto = F.sum("c").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = values.withColumn("last", F.col("below") + upto - 1).withColumn("first", F.col("last") - F.col("c") + 1)

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("first"), F.col("last")), F.col("v")))

    share = F.first(F.col("pos") - F.col("r0"))
    return ranked.groupBy(F.col("g").alias(group)).agg((at("r0") + (at("r1") - at("r0")) * share).alias(name))


def exact_percentile(df: DataFrame, group: str, value: str, fraction: float, name: str) -> DataFrame:
    """Linear-interpolation percentile of ``value`` per group; groups without a value are left out."""
    brackets = df.groupBy(group).agg(*bracket(F.col(value), fraction))
    return percentile_within(df, brackets, group, F.col(value), fraction, name)
