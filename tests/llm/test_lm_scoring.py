"""Matched models of two folds against counting by hand, and scores of documents in and out of the target."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import lm_scoring
from shelfwise.llm.lm_scoring import _packed, _unpacked, cross_entropy_difference, matched, scored, words

SMALL = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, aimed boolean, key string, n long, bucket int, kind int, target double"


def _by_hand(rows, sampled):
    """Scores of (doc_id, text, fold) from the sampled (text, fold, role), by interpolated Kneser-Ney of bigrams."""
    models, known = {}, set()
    for fold in (0, 1):
        for role in (1, 2):
            pairs = Counter()
            for text, f, r in sampled:
                if (f, r) == (fold, role):
                    known |= set(words(text))
                    pairs.update(zip(["<s>", *words(text)], words(text)))
            once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
            totals, kinds, before = Counter(), Counter(), Counter(w for _, w in pairs)
            for (h, _), n in pairs.items():
                totals[h] += n
                kinds[h] += 1
            models[fold, role] = once / (once + 2 * twice) if once and twice else 0.5, pairs, totals, kinds, before

    def loss(model, h, w):
        d, pairs, totals, kinds, before = model
        lower = 1 / (len(known) + 1)
        if pairs:
            lower = max(before[w] - d, 0) / len(pairs) + d * len(before) / len(pairs) * lower
        back = d * kinds[h] / totals[h] if totals[h] else 1.0
        return -math.log((max(pairs[h, w] - d, 0) / totals[h] if totals[h] else 0.0) + back * lower)

    found = []
    for doc_id, text, fold in rows:
        pairs = list(zip(["<s>", *words(text)], words(text)))
        losses = [sum(loss(models[1 - fold, role], h, w) for h, w in pairs) / len(pairs) if pairs else 0.0 for role in (1, 2)]
        found.append((doc_id, len(pairs), *losses))
    return found


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(4)
    made = [" ".join(["Common", "words", *(f"r{int(i)}" for i in rng.zipf(1.4, 30) if i < 4000), "common" if k % 3 else "rare"]) for k in range(240)]
    rows = [(k, t, k % 4 == 0) for k, t in enumerate(made)]
    rows += [rows[0], rows[0], (500, made[0], False), (501, made[5], True), (502, None, True), (None, "", None), (None, made[7], None),
             (503, "words never seen in any other text", False), (504, "Lone", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, aimed boolean")


# Without hot words, with some, and with all of them; one bucket and many.
@pytest.mark.parametrize(("hot", "bucket"), [(0, 10**9), (8, 500), (10**6, 10**9)])
def test_scores_follow_from_the_counts(spark, texts, hot, bucket):
    rows, _ = matched(texts, F.col("aimed"))
    sampled = [(r["text"], r["fold"], r["role"]) for r in rows.collect()]
    fold = {t: f for t, f, _ in sampled}
    for f in (0, 1):
        sizes = [sum(len(t) for t, g, r in sampled if (g, r) == (f, role)) for role in (1, 2)]
        assert 0.5 < sizes[0] / sizes[1] < 2
    want = _by_hand([(r["doc_id"], r["text"], fold.get(r["text"], 0)) for r in texts.collect()], [s for s in sampled if s[2]])
    got = cross_entropy_difference(texts, F.col("aimed"), hot, bucket).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0], r[1], r[2]))
    got, want = order(tuple(r)[:4] for r in got), order(want)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-5)


def test_odd_rows(spark, texts):
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))
    rows = [(k, t, a, "k", 1, 2, 3, 0.5) for k, (t, a) in enumerate([("plain words", True), (None, False), ("", None), (" \n\t ", True), (long, None), ("plain words", None)])]
    odd = spark.createDataFrame([*rows, rows[0]], COLUMNS)
    found = cross_entropy_difference(odd, F.col("aimed")).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found) == [(0, 2), (0, 2), (1, 0), (2, 0), (3, 0), (4, 80_000), (5, 2)]
    assert all(r["score"] == 0 for r in found if not r["n_tokens"])
    alone = cross_entropy_difference(odd, F.lit(False)).collect()
    assert len(alone) == 7 and all(r["score"] == 0 for r in alone)
    none = spark.createDataFrame([], COLUMNS)
    assert cross_entropy_difference(none, F.col("aimed")).count() == 0


def test_arrays_survive_packing():
    arrays = {"a": np.array([3, -1, 2**62]), "b": np.array([], np.uint16), "c": np.arange(5, dtype=np.uint32)}
    back = _unpacked(_packed(**arrays))
    assert all(back[k].dtype == a.dtype and (back[k] == a).all() for k, a in arrays.items())


def test_membership_does_not_move_the_score(spark):
    """Documents of one kind, half of them in the target: both halves score alike, and unlike bad ones."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    scores = cross_entropy_difference(documents, good & (F.col("doc_id") % 2 == 0)).join(documents.select("doc_id", "quality", "toxic"), "doc_id")
    by = defaultdict(list)
    for r in scores.collect():
        if r["quality"] is not None:
            by["bad" if not r["quality"] else "toxic" if r["toxic"] else r["doc_id"] % 2].append(r["score"])
    middle = {k: float(np.median(v)) for k, v in by.items()}
    assert abs(middle[0] - middle[1]) < 0.2
    assert middle["bad"] > max(middle[0], middle[1])


def test_sums_of_many_buckets_leave_as_one_row_a_text(spark, texts, monkeypatch):
    rows = []

    def watched(*args):
        found = scored(*args)
        rows.append((found.count(), found.select("key").distinct().count()))
        return found

    monkeypatch.setattr(lm_scoring, "scored", watched)
    got = cross_entropy_difference(texts, F.col("aimed"), 8, 500)
    assert rows[0][0] == rows[0][1] > 1
    monkeypatch.undo()
    assert sorted(map(str, got.collect())) == sorted(map(str, cross_entropy_difference(texts, F.col("aimed"), 8, 10**9).collect()))
