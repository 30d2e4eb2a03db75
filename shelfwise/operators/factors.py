"""Truncated SVD and non-negative factorisation of the interaction matrix.

The matrix stays in long form ``(row, col, value)``; factors are narrow tables with
columns f0..f{k-1}. While the factors of its smaller side fit a checked size, they travel
with the tasks and a step is one scan (``small_side``). Beyond it both sides are tables: a
product is one join and one aggregate whose sums combine map-side, and only k by k Gram
matrices reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import columns as C
from shelfwise.operators.interactions import enrich_with_defaults
from shelfwise.operators.ranking import top_n
from shelfwise.operators.similarity import dense_top_k
from shelfwise.operators.small_side import SMALL_VALUES, SmallSide
from shelfwise.session import cut_lineage

RANK = 10
OVERSAMPLES = 10
POWER_STEPS = 10
# Steps at most, and the share of the first loss below which one stops.
NMF_STEPS, NMF_TOLERANCE = 200, 1e-5
# Sweeps of coordinate descent a step, while the changes are larger than this share of the first sweep's.
SWEEPS, SWEEP_TOLERANCE = 100, 1e-3
EPSILON = 1e-12


def matrix(behavior: DataFrame) -> DataFrame:
    """Long-form matrix; repeated cells are summed, empty ones left out."""
    return (
        behavior.groupBy(F.col("user_id").alias("row"), F.col("product_id").alias("col"))
        .agg(F.sum("interaction_score").cast("double").alias("value"))
        .where("value != 0")
    )


def names(k: int) -> list[str]:
    return [f"f{i}" for i in range(k)]


def multiply(cells: DataFrame, factors: DataFrame, on: str, by: str, k: int) -> DataFrame:
    """Rows of the matrix product: per ``by`` id, the weighted sum of the ``on`` factors.

    A hot ``on`` id only lengthens the probe side of the join; the sums shrink it to
    one row per ``by`` id and task before the shuffle.
    """
    joined = cells.join(factors.withColumnRenamed("id", on), on)
    return joined.groupBy(F.col(by).alias("id")).agg(
        *[F.sum(F.col("value") * F.col(f)).alias(f) for f in names(k)]
    )


def gram(factors: DataFrame, k: int, extra: list[str] | None = None) -> np.ndarray:
    """Products of the k factor columns with themselves and the extra columns.

    Every task adds up its own rows; what is shuffled and returned has a fixed size,
    whatever the number of rows.
    """
    left = names(k)
    right = left + (extra or [])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(left), len(right)))
        for batch in batches:
            total += batch[left].to_numpy().T @ batch[right].to_numpy()
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    sums = factors.select(*right).mapInPandas(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g"))
    out = np.zeros((len(left), len(right)))
    for i, j, g in sums.collect():
        out[i, j] = g
    return out


def _schema(factors: DataFrame, columns: list[str]) -> str:
    return f"id {factors.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in columns)


def rotate(factors: DataFrame, weights: np.ndarray) -> DataFrame:
    """Factors times a small k by m matrix, batch by batch."""
    k, m = weights.shape

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(batch[names(k)].to_numpy() @ weights, columns=names(m))
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    return factors.mapInPandas(turn, _schema(factors, names(m)))


def _orthonormal(factors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Columns with unit Gram matrix; directions that carry nothing are dropped."""
    values, vectors = np.linalg.eigh(gram(factors, k))
    kept = values > max(values.max(), 0.0) * 1e-13
    return rotate(factors, vectors[:, kept] / np.sqrt(values[kept])), int(kept.sum())


def _uniform(id_column: str, position: int, seed: int) -> Column:
    """A number in (0, 1) that depends on the id alone, so a lost task recomputes the same start."""
    return (F.pmod(F.xxhash64(F.col(id_column), F.lit(position), F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003


def _sides(cells: DataFrame, width: int, limit: int) -> tuple[SmallSide, bool] | None:
    """The smaller side and whether it is that of the columns; None where neither fits."""
    counts = cells.agg(F.approx_count_distinct("col"), F.approx_count_distinct("row")).first()
    by_col = counts[0] <= counts[1]
    small = SmallSide.of(cells, *(("col", "row") if by_col else ("row", "col")), width, limit)
    return (small, by_col) if small else None


def _start(ids: list, like: DataFrame, column: str, values: list[Column]) -> np.ndarray:
    """Start values of a small side, the same as a table of these ids gets."""
    kind = like.schema[column].dataType.simpleString()
    rows = like.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"id {kind}, n int")
    return np.array(rows.select("n", *values).orderBy("n").collect())[:, 1:]


def _uniforms(k: int, seed: int) -> list[Column]:
    return [_uniform("id", j, seed) for j in range(k)]


def svd_factors(
    cells: DataFrame, k: int = RANK, steps: int = POWER_STEPS, seed: int = 42, small_values: int = SMALL_VALUES
) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``(user factors U*S, item factors V, singular values)`` by subspace iteration.

    The rank is cut to what the matrix has. Ids with equal profiles keep equal rows.
    """
    cells = cut_lineage(cells)
    width = k + OVERSAMPLES
    if sides := _sides(cells, width, small_values):
        return _small_svd(cells, *sides, k, width, steps, seed)
    items = cells.select(F.col("col").alias("id")).distinct()
    basis = items.select("id", *[(_uniform("id", j, seed) - 0.5).alias(f"f{j}") for j in range(width)])
    for _ in range(steps):
        scores = multiply(cells, basis, "col", "row", width)
        image = cut_lineage(multiply(cells, scores, "row", "col", width))
        basis, width = _orthonormal(image, width)
    users = cut_lineage(multiply(cells, basis, "col", "row", width))
    vectors, singular = _leading(gram(users, width), k)
    return rotate(users, vectors), rotate(basis, vectors), singular


def _leading(products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(products)
    order = np.argsort(values)[::-1][:k]
    order = order[values[order] > max(values.max(), 0.0) * 1e-13]
    return vectors[:, order], np.sqrt(values[order])


def _small_svd(cells, small: SmallSide, by_col: bool, k: int, width: int, steps: int, seed: int):
    """The same iteration with the basis on the small side; one scan a step."""
    basis = _start(small.ids, cells, "col" if by_col else "row", _uniforms(width, seed)) - 0.5
    for _ in range(steps):
        image, _ = small.sums(basis, _as_it_is)
        values, vectors = np.linalg.eigh(image.T @ image)
        kept = values > max(values.max(), 0.0) * 1e-13
        basis = image @ vectors[:, kept] / np.sqrt(values[kept])
    vectors, singular = _leading(small.sums(basis, _as_it_is)[1], k)
    basis = basis @ vectors
    if by_col:
        return small.large_factors(basis, _as_it_is), small.small_factors(basis, cells, "col"), singular
    # The items are the large side: their factors have unit length, and the users' the singular values.
    return small.small_factors(basis * singular, cells, "row"), small.large_factors(basis / singular, _as_it_is), singular


def power_factors(
    cells: DataFrame, k: int, steps: int, start: Callable[[Column, int], Column], small_values: int = SMALL_VALUES
) -> tuple[DataFrame, DataFrame]:
    """``(user factors, item factors)`` after a fixed number of power steps from given start values.

    Every step multiplies the item columns by the matrix and its transpose and makes them
    orthonormal in order (Gram-Schmidt, worked out on their Gram matrix). Any engine
    that does the same steps gets the same numbers.
    """
    cells = cut_lineage(cells)
    values = [start(F.col("id"), j).cast("double").alias(f"f{j}") for j in range(k)]
    if small := SmallSide.of(cells, "col", "row", k, small_values):
        basis = _start(small.ids, cells, "col", values)
        for _ in range(steps):
            image, _ = small.sums(basis, _as_it_is)
            basis = image @ _upright(image.T @ image)
        return small.large_factors(basis, _as_it_is), small.small_factors(basis, cells, "col")
    items = cells.select(F.col("col").alias("id")).distinct().select("id", *values)
    for _ in range(steps):
        image = cut_lineage(multiply(cells, multiply(cells, items, "col", "row", k), "row", "col", k))
        turn = _upright(gram(image, k))
        items, k = rotate(image, turn), turn.shape[1]
    return multiply(cells, items, "col", "row", k), items


def _upright(products: np.ndarray) -> np.ndarray:
    """What makes columns with these products orthonormal, each from itself and those before it; dependent ones go."""
    out: list[np.ndarray] = []
    for j in range(len(products)):
        column = np.eye(len(products))[j]
        for other in out:
            column = column - other * (other @ products[:, j])
        length = column @ products @ column
        if length > products.max() * 1e-13:
            out.append(column / np.sqrt(length))
    return np.array(out).T


def _as_it_is(rows: np.ndarray) -> np.ndarray:
    return rows


def descend(numerator: np.ndarray, other: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Non-negative rows w with the least |x - w H|, by coordinate descent.

    ``numerator`` is x times the transposed H, ``other`` H times itself. A column is set to
    its best value given the others, for all rows at once, until sweeps change little.
    """
    w = np.zeros_like(numerator) if start is None else start.copy()
    first = None
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(w.shape[1]):
            if other[j, j] > EPSILON:
                new = np.maximum(0.0, w[:, j] + (numerator[:, j] - w @ other[:, j]) / other[j, j])
                moved += float(np.abs(new - w[:, j]).sum())
                w[:, j] = new
        first = moved if first is None else first
        if moved <= SWEEP_TOLERANCE * first:
            break
    return w


def nmf_factors(
    cells: DataFrame, k: int = RANK, steps: int = NMF_STEPS, tolerance: float = NMF_TOLERANCE, seed: int = 42,
    small_values: int = SMALL_VALUES,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """``(user factors W, item factors H, loss per step)`` by alternating non-negative least squares.

    Missing cells count as zero. The loss needs no pass over empty cells: it follows
    from the matrix norm, one product and the two Gram matrices.
    """
    cells = cut_lineage(cells.withColumn("value", C.nonnegative_clamp("value")).where("value > 0"))
    norm, total, count = cells.agg(F.sum(F.col("value") * F.col("value")), F.sum("value"), F.count(F.lit(1))).first()
    if not norm:
        raise ValueError("the matrix has no positive cell")
    scale = float(np.sqrt(total / count / k))
    if sides := _sides(cells, k, small_values):
        return _small_nmf(cells, *sides, k, steps, tolerance, seed, norm, scale)

    items = cut_lineage(cells.select(F.col("col").alias("id")).distinct().select(
        "id", *[(_uniform("id", j, seed) * 2 * scale).alias(f"f{j}") for j in range(k)]))
    item_gram = gram(items, k)
    losses: list[float] = []
    while len(losses) < steps:
        users = cut_lineage(_solved(multiply(cells, items, "col", "row", k), item_gram, k))
        user_gram = gram(users, k)
        items = cut_lineage(_solved(multiply(cells, users, "row", "col", k), user_gram, k))
        products = gram(items, k, numerators(k))
        item_gram, shared = products[:, :k], float(np.trace(products[:, k:]))
        losses.append(norm - 2 * shared + float(np.sum(user_gram * item_gram)))
        if _settled(losses, tolerance):
            break
    return users.select("id", *names(k)), items.select("id", *names(k)), losses


def _settled(losses: list[float], tolerance: float) -> bool:
    return len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[0]


def _small_nmf(cells, small: SmallSide, by_col: bool, k: int, steps: int, tolerance: float, seed: int, norm: float, scale: float):
    """The same with the small side's factors on the driver; one scan a step."""
    column = "col" if by_col else "row"
    factors = _start(small.ids, cells, column, _uniforms(k, seed)) * 2 * scale
    losses: list[float] = []
    while len(losses) < steps:
        other = factors.T @ factors
        numerator, large_gram = small.sums(factors, lambda rows, other=other: descend(rows, other))
        factors = descend(numerator, large_gram, factors)
        losses.append(norm - 2 * float(np.sum(factors * numerator)) + float(np.sum(large_gram * (factors.T @ factors))))
        if _settled(losses, tolerance):
            break
    other = factors.T @ factors
    sides = small.large_factors(factors, lambda rows: descend(rows, other)), small.small_factors(factors, cells, column)
    return (*(sides if by_col else sides[::-1]), losses)


def numerators(k: int) -> list[str]:
    return [f"n{i}" for i in range(k)]


def _solved(numerator: DataFrame, other: np.ndarray, k: int) -> DataFrame:
    """Rows with the least error; the numerators stay beside the new factors for the loss."""
    fs, ns = names(k), numerators(k)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            above = batch[fs].to_numpy()
            out = pd.DataFrame(descend(above, other), columns=fs)
            out.insert(0, "id", batch["id"].to_numpy())
            out[ns] = above
            yield out

    return numerator.mapInPandas(step, _schema(numerator, [*fs, *ns]))


def unit_rows(factors: DataFrame) -> DataFrame:
    """``(id, ws)``: unit rows as arrays; a row of (rounding) zeros stays zero."""
    fs = [c for c in factors.columns if c != "id"]
    norm = F.sqrt(sum((F.col(f) * F.col(f) for f in fs), F.lit(0.0)))
    return factors.select("id", F.array(*[F.when(norm > EPSILON, F.col(f) / norm).otherwise(0.0) for f in fs]).alias("ws"))


def factor_cosine_top(users: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Top n products per user by the cosine of their factors, products already seen included."""
    best = dense_top_k(unit_rows(users), unit_rows(items), n)
    return best.select(
        F.col("qid").alias("user_id"), F.col("vid").alias("product_id"), F.col("sim").alias("mf_score")
    )


def mf_recommend(
    behavior: DataFrame, products: DataFrame, method: str = "svd", n: int = 10, k: int = RANK, **options
) -> DataFrame:
    """Ranked list per user from ``svd`` or ``nmf`` factors, with product columns and score."""
    cells = matrix(behavior)
    if method == "svd":
        users, items, _ = svd_factors(cells, k, **options)
    elif method == "nmf":
        users, items, _ = nmf_factors(cells, k, **options)
    else:
        raise ValueError(f"unknown method {method!r}, expected 'svd' or 'nmf'")
    scored = top_n(factor_cosine_top(users, items, n), "user_id", "mf_score", "product_id", n)
    return (
        enrich_with_defaults(scored, products)
        .withColumn("recommendation_score", C.recommendation_score("mf_score", "popularity_score"))
        .withColumn("algorithm", F.lit(method))
    )
