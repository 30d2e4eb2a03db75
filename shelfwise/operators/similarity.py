"""Exact nearest vectors by cosine, without ever listing all pairs of a group.

Vectors live in long form ``(id, dim, w)`` with unit length. A dimension shared by
few vectors is cheap to expand; one shared by a third of them is not. So

* only dimensions with at most ``short_list`` entries are expanded, which bounds the output
  to ``short_list`` rows per entry; where no other dimension exists, their lists are sent to
  blocks of queries and no pair is shuffled (``short_lists``);
* a query whose remaining (hot) dimensions together weigh less than its k-th best
  match so far is finished by adding the hot part to its few live candidates: nobody
  met through hot dimensions alone can reach it;
* every other query is compared block against block under bounds (``blocks``), so hot
  dimensions cost arithmetic, not shuffled pairs.

While comparing everything in blocks is cheaper than shuffling the joined pairs, that
is done at once. Every choice gives the same result; it only moves work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.columns import ranking_key
from shelfwise.operators.blocks import DECIMALS, SEEDS, dense_rows, packed, rows_of, search
from shelfwise.operators.short_lists import short_top_k
from shelfwise.operators.skew import join_counted
from shelfwise.session import cut_lineage

SHORT_LIST = 64
# A block cell is that much cheaper than a pair that a join has to shuffle.
CELLS_PER_PAIR = 64
# An id with more entries is not put into a block.
HEAVY = 50_000


def unit_vectors(entries: DataFrame, key: str, dim: str, weight: str) -> DataFrame:
    """Long-form ``(id, dim, w)`` of unit length; zero weights carry no similarity and go."""
    rows = entries.select(F.col(key).alias("id"), F.col(dim).alias("dim"), F.col(weight).cast("double").alias("x"))
    rows = rows.where("x != 0")
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.count(F.lit(1)).alias("_n"))
    return join_counted(rows, norms, "id").select("id", "dim", (F.col("x") / F.col("norm")).alias("w"))


def profile_classes(vectors: DataFrame) -> DataFrame:
    """``(id, class)``: ids with the same vector share the smallest of their ids as class.

    Copies are found by two independent 64-bit sums over the entries, combined
    map-side, so no profile is gathered as a list.
    """
    entry = [F.col("dim"), F.round("w", 12)]
    prints = vectors.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*entry).cast("decimal(38,0)")).alias("p1"),
        F.sum(F.xxhash64(F.lit(17), *entry).cast("decimal(38,0)")).alias("p2"),
    )
    keys = ["n", "p1", "p2"]
    smallest = prints.groupBy(*keys).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("_n"))
    return join_counted(prints, smallest, keys).select("id", "class")


def top_k(
    queries: DataFrame, index: DataFrame, k: int, short_list: int = SHORT_LIST,
    cells_per_pair: float = CELLS_PER_PAIR,
) -> DataFrame:
    """``(qid, vid, sim)``: the k best index vectors per query, its own id left out.

    Weights must be non-negative. Order is similarity at nine decimals, then id;
    vectors without common dimensions are no match. Pass checkpointed tables: both
    are read several times.
    """
    lengths = _list_lengths(queries, index)
    is_hot = F.col("length") > short_list
    expanded = F.sum(F.when(~is_hot, F.col("length") * F.col("asked")).otherwise(0.0))
    dims, hot_dims, joined_pairs = lengths.agg(F.count(F.lit(1)), F.count_if(is_hot), expanded).first()
    sides = [side.agg(F.approx_count_distinct("id").alias("n")) for side in (queries, index)]
    cells = sides[0].unionByName(sides[1]).agg(F.product("n")).first()[0]
    if hot_dims == dims or cells <= cells_per_pair * joined_pairs:
        return block_top_k(queries, index, k)
    if not hot_dims:
        return short_top_k(queries, index, k, joined_pairs)
    lengths = cut_lineage(lengths)
    q = queries.select(F.col("id").alias("qid"), "dim", F.col("w").alias("wq"))
    v = index.select(F.col("id").alias("vid"), "dim", F.col("w").alias("wv"))
    short = v.join(lengths.where(~is_hot).select("dim"), "dim", "left_semi")
    near = short.join(q, "dim").where("qid != vid").groupBy("qid", "vid").agg(
        F.sum(F.col("wq") * F.col("wv")).alias("part")
    )
    return _finish(queries, index, q, v, cut_lineage(near), lengths.where(is_hot).select("dim"), k)


def _list_lengths(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``(dim, length, asked)``: index and query entries per dimension."""
    def side(vectors: DataFrame, length: int, asked: int) -> DataFrame:
        return vectors.select("dim", F.lit(length).alias("length"), F.lit(asked).alias("asked"))

    both = side(index, 1, 0).unionByName(side(queries, 0, 1))
    return both.groupBy("dim").agg(F.sum("length").alias("length"), F.sum("asked").alias("asked"))


def _finish(queries, index, q, v, near: DataFrame, hot: DataFrame, k: int) -> DataFrame:
    """Add what hot dimensions contribute to the candidates met through short ones."""
    q_hot = q.join(hot, "dim", "left_semi")
    v_hot = v.join(hot, "dim", "left_semi")
    hot_weight = q_hot.groupBy("qid").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("hot"))
    by_part = W.partitionBy("qid").orderBy(F.desc("part"), "vid")
    kth = (
        near.withColumn("r", F.row_number().over(by_part)).where(F.col("r") <= k)
        .groupBy("qid").agg(F.min(F.when(F.col("r") == k, F.col("part"))).alias("kth"))
    )
    # A query is open when somebody met through hot dimensions alone could still enter its list.
    bounds = cut_lineage(
        hot_weight.join(kth, "qid", "full").select(
            "qid", F.coalesce("hot", F.lit(0.0)).alias("hot"), F.coalesce("kth", F.lit(0.0)).alias("kth")
        )
    )
    is_open = (F.col("hot") > 0) & (F.round("hot", DECIMALS) >= F.round("kth", DECIMALS))
    live = (
        near.join(bounds.where(~is_open), "qid")
        .where(F.col("part") + F.col("hot") + 1e-6 >= F.col("kth"))
        .select("qid", "vid", "part")
    )
    hot_part = (
        live.select("qid", "vid").join(q_hot, "qid").join(v_hot, ["vid", "dim"])
        .groupBy("qid", "vid").agg(F.sum(F.col("wq") * F.col("wv")).alias("rest"))
    )
    finished = live.join(hot_part, ["qid", "vid"], "left").select(
        "qid", "vid", (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("sim")
    )
    open_ids = bounds.where(is_open).select(F.col("qid").alias("id"))
    blocked = block_top_k(queries.join(open_ids, "id", "left_semi"), index, k)
    return _best(finished.unionByName(blocked), k)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy(ranking_key("sim").desc(), "vid")
    best = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.select("qid", "vid", F.round("sim", DECIMALS).alias("sim"))


def block_top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    heavy: int = HEAVY,
    seeds: int = SEEDS,
    **packing,
) -> DataFrame:
    """The k best positive dot products per query, block against block under bounds.

    Ids with more than ``heavy`` entries fit no block. Their products with all others are
    joined entry by entry and added up, combined map-side, so such an id is never one group;
    there are at most entries / heavy of them. Pass checkpointed tables.
    """
    sides = [queries] if queries is index else [queries, index]
    sizes = [side.groupBy("id").agg(F.count(F.lit(1)).alias("n")) for side in sides]
    large = [n.where(F.col("n") > heavy).select("id") for n in sizes]
    greatest = [n.agg(F.max("n")).first()[0] or 0 for n in sizes]
    if max(greatest) <= heavy:
        return _searched(queries, index, k, seeds, packing)
    q_large, v_large = (large * 2)[:2]
    q = queries.select(F.col("id").alias("qid"), "dim", F.col("w").alias("wq"))
    v = index.select(F.col("id").alias("vid"), "dim", F.col("w").alias("wv"))
    q_heavy = q.join(q_large.withColumnRenamed("id", "qid"), "qid", "left_semi")
    v_heavy = v.join(v_large.withColumnRenamed("id", "vid"), "vid", "left_semi")
    q_light = queries.join(q_large, "id", "left_anti")
    light = q_light.select(F.col("id").alias("qid"), "dim", F.col("w").alias("wq"))
    joined = q_heavy.join(v, "dim").unionByName(light.join(v_heavy, "dim")).where("qid != vid")
    products = joined.groupBy("qid", "vid").agg(F.sum(F.col("wq") * F.col("wv")).alias("sim"))
    searched = _searched(cut_lineage(q_light), cut_lineage(index.join(v_large, "id", "left_anti")), k, seeds, packing)
    return _best(products.unionByName(searched), k)


def _searched(queries: DataFrame, index: DataFrame, k: int, seeds: int, packing: dict) -> DataFrame:
    v = packed(rows_of(index), **packing)
    q = v if queries is index else packed(rows_of(queries), **packing)
    return search(q, v, k, seeds=seeds)


def dense_top_k(queries: DataFrame, index: DataFrame, k: int, seeds: int = SEEDS, **packing) -> DataFrame:
    """The k best dot products per query of two tables ``(id, ws array<double>)``, zero and negative ones included."""
    q, v = (packed(dense_rows(side, F.col("ws")), **packing) for side in (queries, index))
    return search(q, v, k, positive_only=False, exclude_same=False, seeds=seeds)


def top_k_of_classes(
    queries: DataFrame, classes: DataFrame, class_vectors: DataFrame, k: int, short_list: int = SHORT_LIST
) -> DataFrame:
    """``(qid, vid, sim)`` for the query ids, computed once per distinct vector.

    ``classes`` maps every id to the smallest id with the same vector. Ids of a class
    answer alike, and only its k + 1 smallest ids can be among anybody's k best. A
    third of all ids being copies of one vector costs one comparison and k + 1 rows.
    Pass checkpointed tables.
    """
    wanted, query_vectors = classes, class_vectors
    if queries is not classes:
        wanted = queries.select("id").join(classes, "id")
        asked = wanted.select(F.col("class").alias("id")).distinct()
        query_vectors = cut_lineage(class_vectors.join(asked, "id", "left_semi"))
    if classes.where("id != class").isEmpty():  # no copies
        return top_k(query_vectors, class_vectors, k, short_list)
    between = top_k(query_vectors, class_vectors, k + 1, short_list)
    within = query_vectors.select("id").distinct().select(
        F.col("id").alias("qid"), F.col("id").alias("vid"), F.lit(1.0).alias("sim")
    )
    smallest = W.partitionBy("class").orderBy("id")
    members = (
        classes.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
        .select(F.col("class").alias("vid"), F.col("id").alias("member"))
    )
    per_class = _best(
        between.unionByName(within).join(members, "vid").select("qid", F.col("member").alias("vid"), "sim"), k + 1
    )
    answers = wanted.join(per_class.withColumnRenamed("qid", "class"), "class").where("id != vid")
    return _best(answers.select(F.col("id").alias("qid"), "vid", "sim"), k)
