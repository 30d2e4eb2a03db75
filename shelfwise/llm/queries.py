"""One registered query per operator, with its production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import load
from shelfwise.llm.decontamination import contamination
from shelfwise.llm.exact_dedup import exact_duplicates
from shelfwise.llm.html_extraction import main_text
from shelfwise.llm.language import identify
from shelfwise.llm.lm_scoring import cross_entropy_difference
from shelfwise.llm.packing import packed
from shelfwise.llm.prefix_trie import conversation_trie
from shelfwise.llm.pii import KINDS, counted, find, joined
from shelfwise.llm.quality import quality
from shelfwise.llm.sharding import shard_rows
from shelfwise.llm.simhash import near_duplicates
from shelfwise.llm.toxicity import toxicity
from shelfwise.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, part_codes

#: Label ids, 8 bytes each, that are sent along with the tasks; more are merged by a shuffle.
LABELS_SENT = 2_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return register


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("row")


@query("op5_decontamination", """
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM documents),
    b AS (
      SELECT item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (
      SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
      FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
    dw AS (
      SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(w) - n + 2)) AS t(i)),
    hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
    covered AS (
      SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
    found AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(joined, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents")).drop("p_good")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(counted(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good and not toxic; background: as much of the others.

    The labels grow with the documents: their ids are broadcast up to ``LABELS_SENT`` of them and merged beyond.
    """
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    good = load(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct().withColumn("aimed", F.lit(True))
    if good.count() <= LABELS_SENT:
        good = F.broadcast(good)
    return cross_entropy_difference(documents.join(good, "doc_id", "left"), F.col("aimed"))


@query("op4_html")
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))


@query("op13_exact_dedup", """
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
    FROM d WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id ASC NULLS LAST)
""")
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


@query("op12_prefix_trie", """
    WITH t AS (
      SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
             dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT conv_id, list(id ORDER BY turn NULLS FIRST, digest) AS ids, list(words ORDER BY turn NULLS FIRST, digest) AS words,
             -- crc32 of the decimal conv_id, bit by bit
             xor(list_reduce(
               list_prepend(4294967295::BIGINT, [CASE WHEN k % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT
                                                 FOR k IN range(8 * length(conv_id::VARCHAR))]),
               lambda crc, bit: xor(xor(crc, bit) >> 1, (xor(crc, bit) & 1) * 3988292384)), 4294967295) % 4 AS h
      FROM t GROUP BY conv_id),
    r AS (
      SELECT c.conv_id, list_concat(coalesce(b.ids[1:c.h], []), c.ids[c.h + 1:]) AS ids,
             list_concat(coalesce(b.words[1:c.h], []), c.words[c.h + 1:]) AS words
      FROM own AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 20),
    p AS (SELECT conv_id, ids, words, unnest(range(len(ids) + 1)) AS depth FROM r),
    n AS (
      SELECT ids[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words[depth]), 0) AS w,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = depth), '')) AS ends_sha256
      FROM p GROUP BY ALL),
    kids AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (prefix, depth)),
    up AS (SELECT prefix, n_convs, w, n_children, unnest(range(depth + 1)) AS depth FROM k),
    subtree AS (
      SELECT prefix[1:depth] AS prefix, depth, sum((n_convs - 1) * w)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM up GROUP BY ALL)
    SELECT k.conv_id, k.depth, above.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
    FROM k JOIN subtree USING (prefix, depth)
    LEFT JOIN k AS above ON k.depth > 0 AND above.depth = k.depth - 1 AND above.prefix = k.prefix[1:k.depth - 1]
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(load(spark, sf_dir, "conversations"))


def codes_sql(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """Each round of the codebooks as two common table expressions."""
    sql = f"""
    WITH kept AS (
      SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, v FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    p AS MATERIALIZED (
      SELECT r, vec_id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(part)),
    c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries}),"""
    for k in range(rounds + 1):
        sql += f"""
    a{k} AS MATERIALIZED (
      SELECT r, part, min(d * {entries} + entry) AS best FROM (
        SELECT r, p.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM p JOIN c{k} AS c ON p.part = c.part)
      GROUP BY ALL),"""
        if k < rounds:
            sql += f"""
    s{k} AS (
      SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
        SELECT part, best % {entries} AS entry, i, sum(x[i]) AS s, count(*) AS n
        FROM a{k} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL)
      GROUP BY ALL),
    c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.c, c.c) AS c FROM c{k} AS c LEFT JOIN s{k} AS s USING (part, entry)),"""
    return sql + f"""
    book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
    e AS (
      SELECT r, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error
      FROM a{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM e JOIN kept USING (r), book
    """


@query("op11_vector_codes", codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes(load(spark, sf_dir, "embeddings"))
