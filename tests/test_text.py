import math
import re
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise.operators import search as S
from shelfwise.operators import text as X
from shelfwise.operators.text import tfidf, vocabulary

DOCS = {1: "The red ring, the RED bolt", 2: "ring ring a bolt of Đồng", 3: "", 4: "x y z", 5: "red ring"}


def expected_tfidf(docs, stop, limit):
    counts = {}
    for i, text in docs.items():
        words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in stop]
        counts[i] = Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:]))
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    kept = sorted(total, key=lambda t: (-total[t], t))[:limit]
    out = {}
    for i, c in counts.items():
        raw = {t: c[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in kept if t in c}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(i, t): x / norm for t, x in raw.items()})
    return out


@pytest.mark.parametrize("limit", [3, 5000])
def test_tfidf(spark, limit):
    docs = spark.createDataFrame(list(DOCS.items()), "doc int, text string")
    got = {(r.id, r.dim): r.w for r in tfidf(docs, "doc", "text", stop_words=["the", "of"], limit=limit).collect()}
    assert got == pytest.approx(expected_tfidf(DOCS, {"the", "of"}, limit))


def test_copies_weigh_as_often_as_they_occur(spark):
    repeated = {i: t for i, t in enumerate(["red ring"] * 5 + ["blue ring"])}
    plain = spark.createDataFrame(list(repeated.items()), "doc int, text string")
    merged = spark.createDataFrame([(0, "red ring", 5), (5, "blue ring", 1)], "doc int, text string, n long")
    one = {(r.id, r.dim): r.w for r in tfidf(plain, "doc", "text").where("id in (0, 5)").collect()}
    two = {(r.id, r.dim): r.w for r in tfidf(merged, "doc", "text", copies="n").collect()}
    assert one == pytest.approx(two)


def test_vocabulary_ties_go_by_term(spark):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "c", 9)], "id int, term string, tf long")
    assert [r.term for r in vocabulary(counts, limit=2).orderBy("term").collect()] == ["a", "c"]


def expected_bm25(texts, terms):
    tokens = {i: [t for t in re.split(r"[^\w]+|_", x.lower()) if t] for i, x in texts.items()}
    n = sum(1 for t in tokens.values() if t)
    mean = sum(map(len, tokens.values())) / n
    out = {}
    for i, words in tokens.items():
        score = 0.0
        for term in terms:
            tf, df = words.count(term), sum(term in t for t in tokens.values())
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        out[i] = score
    return out


def test_bm25_and_search_order(spark):
    names = {1: "red ring", 2: "Ring of the north", 3: "blue bolt", 4: "red red lamp"}
    places = {1: "Hanoi", 2: "Red River", 3: "Hanoi", 4: ""}
    df = spark.createDataFrame(
        [(i, names[i], places[i] or None, p) for i, p in zip(names, [1.0, 1.0, 9.0, 5.0])],
        "product_id int, name string, location string, popularity_score double")
    a, b = expected_bm25(names, ["red", "ring"]), expected_bm25(places, ["red", "ring"])
    scores = {i: max(3 * a[i], b[i]) for i in names}
    got = S.scored_matches(df, "RED ring!", S.PRODUCT_FIELDS).collect()
    assert {r.product_id: r.relevance for r in got} == pytest.approx({i: s for i, s in scores.items() if s > 0})
    order = [r.product_id for r in S.search_products(df, "red ring").collect()]
    assert order == [4, *sorted((1, 2), key=lambda i: -scores[i])]
    assert S.search_products(df, " ... ").count() == 0


def test_inverted_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(list(DOCS.items()), "doc int, text string")
    postings = S.build_inverted_index(docs, "doc", "text")
    got = {(r.term, r.id): (r.tf, r.first_position) for r in postings.collect()}
    assert got[("ring", 2)] == (2, 0) and got[("red", 1)] == (2, 1) and ("", 3) not in got
    S.write_inverted_index(postings, str(tmp_path / "index"), buckets=4)
    read = S.read_postings(spark, str(tmp_path / "index"), ["ring", "red"], buckets=4)
    assert {(r.term, r.id) for r in read.collect()} == {k for k in got if k[0] in ("ring", "red")}
    df = {r.term: (r.df, r.occurrences) for r in S.document_frequency(postings).collect()}
    assert df["ring"] == (3, 4) and df["red"] == (2, 3)


def test_terms_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    """The tasks that count terms grow in number with the texts, not in size; the counts stay the same."""
    docs = spark.range(40).selectExpr("id AS doc", "concat('red ring ', id, repeat(' blue', 20)) AS text")

    def counted():
        postings = S.build_inverted_index(docs, "doc", "text")
        return postings.rdd.getNumPartitions(), rows(postings), rows(X.term_counts(docs, "doc", "text"))

    whole = counted()
    monkeypatch.setattr(X, "TASK_CHARS", 100)
    parts = counted()
    assert parts[0] > 30 and whole[0] == 1
    assert parts[1:] == whole[1:]


def test_tfidf_sends_a_term_once_a_block_and_stores_no_counts(spark, monkeypatch):
    """Texts are shuffled whole; what a block sends and gets back has a row a term, not a row a text and term."""
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * j) % 11}" for j in range(1, 30))) for i in range(60)] + [(77, None), (78, "")], "doc long, text string").repartition(3)
    texts = {r.doc: r.text or "" for r in docs.collect()}
    for chars in (4_000_000, 900, 40):
        monkeypatch.setattr(X, "TASK_CHARS", chars)
        vectors = tfidf(docs, "doc", "text", stop_words=[])
        plan = vectors._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan.split("Union")[0] and "Exchange hashpartitioning" not in plan.split("Union")[0] and "SortMergeJoin" not in plan
        got = {(r.id, r.dim): r.w for r in vectors.collect()}
        assert got == pytest.approx(expected_tfidf(texts, set(), None))
    labels = {r.slot: r.block for r in X.block_labels(spark, 300).collect()}
    assert len(labels) == 300
    of = spark.createDataFrame([(b,) for b in labels.values()], "block long").repartition(300, "block")
    assert of.select(F.spark_partition_id()).distinct().count() == 300
