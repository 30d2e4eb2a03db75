"""Toxicity by class-conditional Kneser-Ney models over the spelling of words.

Two character n-gram models, one of toxic and one of ordinary documents, read every
word from its start mark to its end mark. The highest order is counted per class; all
lower orders are Kneser-Ney continuation counts of both classes together, so a rare
expression is smoothed towards what both share and only what the classes really write
differently moves the score. A document's evidence is the difference of the two
log-likelihoods, normalised by length: per word over the whole text, and per word over its
``BEST`` most toxic words, since abuse may be a few words scattered over a long text.
A logistic calibration, fitted on labelled documents that the models have not seen, turns
them and the length into a probability.

Defined results: a null or empty text, or one without letters, has no evidence either
way and gets the calibrated score of zero evidence; repeated rows get equal scores; other
columns of the input are carried in ``row``; an empty table gives an empty result, and where a class
has no labelled document in the table every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import HELD_OUT, first_by_hash, fold, held_out

#: Long enough that a word's start and its stem fit into one n-gram.
ORDER = 9
BEST = (3, 8)
#: Bound of the labelled sample: documents of each class, for counting and again for calibration. All its n-grams are kept.
SAMPLE = 3000
#: Words whose score a task remembers before it starts afresh.
MEMORY = 200_000
THRESHOLD = 0.3
CALIBRATION_FOLD = 3

_LETTERS = re.compile(r"[^\W\d_]+")


def _discount(counts: np.ndarray) -> float:
    """Absolute discount from the numbers of events seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def _cut(grams: np.ndarray, first: int, last: int) -> np.ndarray:
    """The characters from ``first`` to ``last`` of n-grams of one length."""
    letters = grams.view(np.uint32).reshape(len(grams), grams.itemsize // 4)[:, first:last]
    return np.ascontiguousarray(letters).view(f"<U{last - first}").ravel()


def shared_probabilities(grams: np.ndarray, order: int) -> np.ndarray:
    """Interpolated Kneser-Ney continuation probability of each n-gram without its first character.

    ``grams`` are the distinct n-grams of both classes together.
    """
    levels = []  # from the longest suffixes to single characters: (distinct, in how many longer ones, their place)
    longer = grams
    for n in range(order - 1, 0, -1):
        kept, place, counts = np.unique(_cut(longer, 1, n + 1), return_inverse=True, return_counts=True)
        levels.append((kept, place, counts))
        longer = kept
    lower = np.array([1.0 / (max(1, len(longer)) + 1)])
    place = np.zeros(len(longer), np.int64)
    for n, (kept, shorter, counts) in enumerate(reversed(levels), 1):
        context = np.unique(_cut(kept, 0, n - 1), return_inverse=True)[1] if n > 1 else np.zeros(len(kept), np.int64)
        total, kinds, d = np.bincount(context, counts), np.bincount(context), _discount(counts)
        lower = np.maximum(counts - d, 0) / total[context] + d * kinds[context] / total[context] * lower[place]
        place = shorter
    return lower[place]


def _grams(word: str, order: int) -> Iterator[str]:
    marked = "\x02" * (order - 1) + word + "\x03"
    for i in range(len(marked) - order + 1):
        yield marked[i : i + order]


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """How often each class writes each n-gram; ``texts`` has toxic and text."""
    def count(batches):
        for batch in batches:
            seen: list[Counter] = [Counter(), Counter()]
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[toxic].update((text or "").lower().split())
            for toxic, words in enumerate(seen):
                grams: Counter = Counter()
                for word, n in words.items():
                    for run in _LETTERS.findall(word):
                        for gram in _grams(run, order):
                            grams[gram] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())],
                    ["toxic", "gram", "n"])

    rows = texts.select(F.col("toxic").cast("int").alias("toxic"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "toxic int, gram string, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))


class ClassModels:
    """What scoring needs of the two models.

    Where neither class has seen a letter after its context, both fall back on the same
    shared probability, which cancels out: only the backoff weights remain. So the log
    ratio of each seen n-gram and of the backoff weights of each seen context suffice.
    They are sent as sorted arrays; a task that reads words makes them dictionaries.
    """

    def __init__(self, toxic: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.grams, place = np.unique(grams.astype(f"<U{order}"), return_inverse=True)
        self.contexts, context = np.unique(_cut(self.grams, 0, order - 1), return_inverse=True)
        lower = shared_probabilities(self.grams, order)
        logs, weights = [], []
        for c in (0, 1):
            seen = np.bincount(place[toxic == c], counts[toxic == c], len(self.grams))
            total = np.bincount(context, seen, len(self.contexts))
            kinds = np.bincount(context, seen > 0, len(self.contexts))
            d, safe = _discount(seen), np.maximum(total, 1)
            weight = np.where(total > 0, d * kinds / safe, 1.0)
            logs.append(np.log(np.maximum(seen - d, 0) / safe[context] + weight[context] * lower))
            weights.append(np.log(weight))
        self.ratios, self.backoffs = logs[1] - logs[0], weights[1] - weights[0]

    @cached_property
    def ratio(self) -> dict[str, float]:
        return dict(zip(self.grams.tolist(), self.ratios.tolist(), strict=True))

    @cached_property
    def backoff(self) -> dict[str, float]:
        return dict(zip(self.contexts.tolist(), self.backoffs.tolist(), strict=True))

    def word(self, word: str) -> float:
        """Toxic minus ordinary log-likelihood of a word."""
        ratio, backoff, total = self.ratio, self.backoff, 0.0
        for run in _LETTERS.findall(word):
            for gram in _grams(run, self.order):
                total += ratio[gram] if gram in ratio else backoff.get(gram[:-1], 0.0)
        return total


class WordScores(dict):
    """Word scores by spelling, computed once and forgotten when too many."""

    def __init__(self, models: ClassModels):
        super().__init__()
        self.models = models

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = self.models.word(word)
        return value


def evidence(text: str | None, scores: WordScores) -> list[float]:
    """Log-likelihood difference per word: of the whole text, of its most toxic words; then its words."""
    words = (text or "").lower().split()
    if not words:
        return [0.0] * (len(BEST) + 2)
    found = np.fromiter(map(scores.__getitem__, words), float, len(words))
    highest = -np.sort(np.partition(-found, max(BEST))[: max(BEST)] if len(found) > max(BEST) else -found)
    return [float(found.mean()), *(float(highest[:k].sum() / k) for k in BEST), float(len(words))]


RATIOS = ["mean_ratio", *(f"best_{k}_ratio" for k in BEST)]
EVIDENCE = [*RATIOS, "n_words"]


def with_evidence(documents: DataFrame, models) -> DataFrame:
    """Add the evidence of every whole ``text``; the table must not hold columns of these names."""
    names = documents.columns

    def score(batches):
        scores = WordScores(models.value)
        for batch in batches:
            found = [evidence(t, scores) for t in batch.column("text").to_pylist()]
            columns = np.array(found, float).reshape(len(found), len(EVIDENCE)).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*names, *EVIDENCE])

    return documents.mapInArrow(score, T.StructType([*documents.schema, *(T.StructField(c, T.DoubleType()) for c in EVIDENCE)]))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant is the last coefficient."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * len(x) * np.append(beta[:-1], 0)
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, order: int = ORDER):
    """Class models and calibration from labelled documents outside the held-out fold.

    Returns (models, beta); models is None where a class has no document, and beta then
    holds the share of toxic labels.
    """
    spark = documents.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(fold() != HELD_OUT)
        .withColumn("calibrates", (fold() == CALIBRATION_FOLD).cast("int"))
    )
    sizes = {(r["toxic"], r["calibrates"]): r["count"] for r in known.groupBy("toxic", "calibrates").count().collect()}
    share = sum(n for (t, _), n in sizes.items() if t) / max(1, sum(sizes.values()))
    if not all(sizes.get((t, 0)) for t in (0, 1)):
        return None, np.array([share])
    chosen = F.broadcast(first_by_hash(known, ["toxic", "calibrates"], sample))  # 4 * sample rows at most
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    table = gram_counts(texts.where("calibrates = 0"), order).toArrow()
    toxic, counts = table.column("toxic").to_numpy(), table.column("n").to_numpy()
    grams = np.fromiter((g for part in table.column("gram").chunks for g in part.to_pylist()), f"<U{order}", len(table))
    del table
    models = ClassModels(toxic, grams, counts, order)
    del toxic, grams, counts
    shared = spark.sparkContext.broadcast(models)
    # Where the calibration fold lacks a class, the counted documents stand in.
    part = 1 if all(sizes.get((t, 1)) for t in (0, 1)) else 0
    rows = with_evidence(texts.where(F.col("calibrates") == part), shared).drop("text").collect()
    x = np.array([[*(r[c] for c in RATIOS), math.log1p(r["n_words"])] for r in rows]).reshape(len(rows), len(EVIDENCE))
    y = np.array([float(r["toxic"]) for r in rows])
    if not y.any() or y.all():  # labels of documents that the table does not hold
        return None, np.array([share])
    taken = {t: int((y == t).sum()) for t in (0, 1)}
    weight = np.array([sizes[(int(t), part)] / taken[int(t)] for t in y])
    weight *= len(weight) / weight.sum()
    return shared, fit_logistic(x, y, weight)


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on), the evidence behind it, and row.

    ``row`` is the whole input row as a struct, so that a filter can return it whatever its columns are called.
    """
    models, beta = fit(documents, labels, sample)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("row"))
    if models is None:
        found, logit = rows.withColumns({c: F.lit(0.0) for c in EVIDENCE}), None
    else:
        found = with_evidence(rows, models)
        terms = [*(F.col(c) for c in RATIOS), F.log1p("n_words"), F.lit(1.0)]
        logit = sum((F.lit(float(b)) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0))
    score = F.lit(float(beta[0])) if logit is None else 1 / (1 + F.exp(-logit))
    return found.withColumn("score", score).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *RATIOS, F.col("n_words").cast("long").alias("n_words"),
        F.struct(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in documents.columns)).alias("row"),
    )
