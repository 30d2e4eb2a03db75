"""Exact duplicates by skew-safe combining, comparing full content at every stage.

Texts are equal when they are identical after white space is deleted. Of equal texts the
row with the most code points stays, then the smallest doc_id (a null one is the largest),
then the first in the stored order. DataFrame operations only:

1. *Rows*: doc_id, length and digest of every row are stored once; texts stay where they are.
2. *Local*: every task combines its own rows by (digest, salt, text) before it shuffles
   anything, so copies within a task leave it as one row.
3. *Salted groups*: what the tasks send meets by (digest, salt, text). The salt is zero but
   for hot digests, whose groups are dealt over ``SALTS`` places; every other group is
   whole here, so its text is shuffled once.
4. *Global*: the few salt winners of hot digests are combined by (digest, text).

The text itself is a grouping key in each of these, so two different texts with one digest
are two groups. Rows get their group by a join of two stored tables on the digest, where a
hot digest only lengthens one side, which Spark splits. Rows of a digest that has several
groups are told apart by their texts instead.

Defined results: a null text counts as empty; empty texts and texts of white space only are
equal; null doc_ids are documents; of repeated rows exactly one can stay; very long texts
are compared whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

#: Bytes of the digest of which groups are made; a short one is slower, but as right.
DIGEST_BYTES = 32
#: Places over which the groups of a hot digest are dealt.
SALTS = 64
#: A digest is hot from this many rows on, and from this share of all rows on: 1 / share digests at most.
HOT_ROWS, HOT_SHARE = 1000, 1e-4
#: The white space that does not count (fixed value).
BLANKS = "[\\x20\\x09-\\x0D]+"


def _read(documents: DataFrame, digest_bytes: int) -> DataFrame:
    """doc_id, length, sha, digest and normalised text of every row."""
    text = F.col("text").cast("string")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("length"),
        F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "").alias("text"),
    ).withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))


def _best() -> Column:
    """The greatest stays: long texts first, then small ids, null ids last."""
    return F.max(F.struct("length", (-F.col("doc_id")).alias("low"))).alias("best")


def text_groups(documents: DataFrame, rows: DataFrame, digest_bytes: int, salts: int, hot_rows: int) -> DataFrame:
    """digest, best and group_size of every group of equal texts."""
    bound = max(hot_rows, rows.count() * HOT_SHARE)
    hot = rows.groupBy("digest").count().where(F.col("count") >= bound).select("digest", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), 1 + F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    salted = (
        _read(documents, digest_bytes).join(F.broadcast(hot), "digest", "left").withColumn("salt", salt)
        .groupBy("digest", "salt", "text").agg(_best(), F.count(F.lit(1)).alias("group_size"))
    )
    # Only the winners of salted groups still need their text.
    salted = stored(salted.withColumn("text", F.when(F.col("salt") > 0, F.col("text"))), "dedup-salted")
    combined = salted.where("salt > 0").groupBy("digest", "text").agg(
        F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
    same = ["digest", "best", "group_size"]
    return stored(salted.where("salt = 0").select(*same).unionByName(combined.select(*same)), "dedup-groups")


def exact_duplicates(
    documents: DataFrame, digest_bytes: int = DIGEST_BYTES, salts: int = SALTS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    read = _read(documents, digest_bytes).withColumn("place", F.monotonically_increasing_id())
    rows = stored(read.drop("text"), "dedup-rows")
    groups = text_groups(documents, rows, digest_bytes, salts, hot_rows)
    shared = groups.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        return _marked(rows, groups, ["digest"])
    apart = stored(read.join(shared, "digest", "left_semi"), "dedup-apart")
    by_text = apart.groupBy("digest", "text").agg(_best(), F.count(F.lit(1)).alias("group_size"))
    alone = rows.join(shared, "digest", "left_anti")
    return _marked(alone, groups, ["digest"]).unionByName(_marked(apart, by_text, ["digest", "text"]))


def _marked(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group; of repeated rows only the first can stay."""
    document = ["doc_id", "length", "sha"]
    repeated = rows.groupBy(*document).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    found = rows.join(groups, keys).withColumn("keep_id", -F.col("best.low"))
    stays = (F.col("length") == F.col("best.length")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not repeated.isEmpty():
        same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.length") == F.col("f.length")) & (F.col("r.sha") == F.col("f.sha"))
        found = found.alias("f").join(repeated.alias("r"), same, "left").select("f.*", "r.first")
        stays = stays & (F.col("place") == F.coalesce("first", "place"))
    return found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
