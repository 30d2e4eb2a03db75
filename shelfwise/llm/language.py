"""Language identification with a blended-spectrum string kernel.

Two texts are as similar as the character n-grams of 1 to 3 letters they have in common:
the kernel counts n-grams present in both, normalised to one for equal texts. ``LANDMARKS``
labelled texts stand for the kernel's feature space (Nyström); one-versus-rest kernel ridge
regression on that space is fitted to the labelled sample. A batch of documents is scored by
two matrix products: presence matrix times landmark matrix, times coefficients.

N-grams run over an alphabet of the ``SYMBOLS - 2`` most frequent letters of the sample, one
symbol for other letters, one for everything between words; presence is a flag per n-gram.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text where no row has a language to learn. Whole texts are read, however long. Ties go to
the first language by name. Repeated rows get equal answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import HELD_OUT, first_by_hash, fold, held_out

UNKNOWN = "und"
#: Bounds of the labelled sample: rows of each language, and rows in all.
PER_LANGUAGE = 400
MAX_SAMPLE = 20_000
LANDMARKS = 192
RIDGE = 1e-3
SYMBOLS = 64
#: Rows multiplied at once.
ROWS = 64


class Spectrum:
    """Presence of n-grams of 1 to 3 symbols as flags over all of them."""

    def __init__(self, letters: list[str]):
        self.table = np.zeros(0x110000, np.uint8)  # 0: not a letter
        self.table[[c for c in range(0x3000) if chr(c).isalpha()]] = 1
        self.table[0x3000:] = 1
        self.table[[ord(c) for c in letters]] = np.arange(2, 2 + len(letters))
        self.size = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
        self.flags = np.zeros(self.size, bool)

    def present(self, text: str) -> np.ndarray:
        """Sorted numbers of the n-grams in the text."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[points].astype(np.int32)
        s = s[(s > 0) | np.append(True, s[:-1] > 0)]  # one gap between words
        flags = self.flags
        flags[s] = True
        two = s[:-1] * SYMBOLS + s[1:]
        flags[SYMBOLS + two] = True
        flags[SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + s[2:]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        return found


class Model:
    """Landmarks and coefficients, both bounded by parameters."""

    def __init__(self, rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        letters = Counter()
        for text, _ in rows:
            letters.update(Counter(c for c in text.lower() if c.isalpha()))
        self.letters = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2] if len(c) == 1]
        self.languages = sorted({lang for _, lang in rows})
        spectrum = Spectrum(self.letters)
        found = [spectrum.present(text) for text, _ in rows]
        chosen = self._spread([lang for _, lang in rows], landmarks)
        # Columns are the n-grams that some landmark has; no other adds to a kernel value.
        self.columns = np.unique(np.concatenate([found[i] for i in chosen]))
        self.matrix = np.stack([np.isin(self.columns, found[i]) / np.sqrt(len(found[i])) for i in chosen]).astype(np.float32).T
        kernel = np.stack([self.kernel(f) for f in found]).astype(float)
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        features = np.column_stack([kernel @ root, np.ones(len(rows))])
        target = np.array([[lang == x for x in self.languages] for _, lang in rows], float)
        shrink = ridge * len(rows) * np.eye(features.shape[1])
        shrink[-1, -1] = 0
        weights = np.linalg.solve(features.T @ features + shrink, features.T @ target)
        self.weights, self.constant = (root @ weights[:-1]).astype(np.float32), weights[-1]

    @staticmethod
    def _spread(languages: list[str], n: int) -> list[int]:
        """Landmarks in turn from each language."""
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(languages):
            by.setdefault(lang, []).append(i)
        turns = [rows[k] for k in range(max(map(len, by.values()))) for _, rows in sorted(by.items()) if k < len(rows)]
        return turns[:n]

    def kernel(self, found: np.ndarray) -> np.ndarray:
        return (np.isin(self.columns, found).astype(np.float32) / np.sqrt(max(1, len(found)))) @ self.matrix

    def scored(self, texts: list[str | None], spectrum: Spectrum) -> Iterator[tuple[str, float]]:
        where = np.full(spectrum.size, len(self.columns), np.int32)
        where[self.columns] = np.arange(len(self.columns))
        presence = np.zeros((ROWS, len(self.columns) + 1), np.float32)
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            norms, letters = np.ones(len(part)), [t is not None and any(map(str.isalpha, t)) for t in part]
            presence[:] = 0
            for i, text in enumerate(part):
                if letters[i]:
                    found = spectrum.present(text)
                    presence[i, where[found]] = 1
                    norms[i] = len(found)
            similar = (presence[: len(part), :-1] @ self.matrix) / np.sqrt(norms)[:, None]
            outputs = similar @ self.weights + self.constant
            for known, row in zip(letters, outputs, strict=True):
                best = int(row.argmax())
                yield (self.languages[best], float(min(1.0, max(0.0, row[best])))) if known else (UNKNOWN, 0.0)


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Learn from rows with a language outside the held-out fold; only their text and lang are used."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    chosen = first_by_hash(known, ["lang"], per_language).orderBy(F.xxhash64("doc_id"), "lang").limit(MAX_SAMPLE)
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
        .where(F.col("text").rlike(r"\p{L}"))
        .join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])  # MAX_SAMPLE rows at most
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(MAX_SAMPLE).collect()
    )
    return Model([(r["text"], r["lang"]) for r in rows], landmarks) if rows else None


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every whole text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(documents, per_language, landmarks)
    if model is None:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        spectrum = Spectrum(shared.value.letters)
        for batch in batches:
            found = list(shared.value.scored(batch.column("text").to_pylist(), spectrum))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
