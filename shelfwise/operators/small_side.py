"""A long-form matrix of which one side is small enough to be sent to every task.

The other side's rows are stored once as ``(id, places, values)``. A step sends the small
side's factors along with the task, works row by row on the large side and gets back sums of
the small side's size: one scan and one aggregate, combined in each task, with nothing of
the large side shuffled. A row has at most as many cells as the small side has ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import scratch_path

#: Values of the small side's factors at most: 1.6 MB. Larger ones stay tables.
SMALL_VALUES = 200_000
Rows = Callable[[np.ndarray], np.ndarray]


class SmallSide:
    def __init__(self, blocks: DataFrame, ids: list):
        self.blocks, self.ids = blocks, ids

    @staticmethod
    def of(cells: DataFrame, small: str, large: str, width: int, limit: int = SMALL_VALUES) -> SmallSide | None:
        """None where the small side has more than ``limit / width`` ids."""
        most = limit // width
        ids = [r[0] for r in cells.select(small).distinct().limit(most + 1).collect()]
        if len(ids) > most:
            return None
        ids.sort()
        spark = cells.sparkSession
        places = spark.createDataFrame(
            [(i, k) for k, i in enumerate(ids)], f"_small {cells.schema[small].dataType.simpleString()}, place int")
        placed = cells.join(F.broadcast(places), F.col(small) == F.col("_small"))  # most rows at most
        path = scratch_path(spark, "small-side")
        (
            placed.groupBy(F.col(large).alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("c"))
            .select("id", F.col("c.place").alias("places"), F.col("c.value").alias("values")).write.parquet(path)
        )
        return SmallSide(spark.read.parquet(path), ids)

    def sums(self, factors: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(transposed matrix times W, W times W), W being ``rows`` of the matrix times the factors."""
        n, width = factors.shape

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, gram = None, None
            for batch in batches:
                places, values, row = _cells(batch)
                w = rows(_product(places, values, row, len(batch), factors))
                if total is None:
                    total, gram = np.zeros((n, w.shape[1])), np.zeros((w.shape[1],) * 2)
                for f in range(w.shape[1]):
                    total[:, f] += np.bincount(places, values * w[row, f], minlength=n)
                gram += w.T @ w
            if total is not None:
                met = np.flatnonzero(total.any(1))
                both = np.concatenate([total[met], gram])
                place = np.concatenate([met, n + np.arange(len(gram))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(place, both.shape[1]), pa.int32()), pa.array(np.tile(np.arange(both.shape[1]), len(both)), pa.int32()), pa.array(both.ravel())],
                    ["place", "f", "x"])

        found = self.blocks.mapInArrow(add, "place int, f int, x double").groupBy("place", "f").agg(F.sum("x").alias("x")).collect()
        place, f, x = (np.array(c) for c in zip(*found, strict=True))
        out = np.zeros((n + f.max() + 1, f.max() + 1))
        out[place, f] = x
        return out[:n], out[n:]

    def large_factors(self, factors: np.ndarray, rows: Rows) -> DataFrame:
        """``(id, f0..)`` of the large side."""
        width = rows(np.zeros((1, factors.shape[1]))).shape[1]

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = rows(_product(*_cells(batch), len(batch), factors))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array(w[:, f]) for f in range(width))], ["id", *(f"f{f}" for f in range(width))])

        kind = self.blocks.schema["id"].dataType.simpleString()
        return self.blocks.mapInArrow(write, ", ".join([f"id {kind}", *(f"f{f} double" for f in range(width))]))

    def small_factors(self, factors: np.ndarray, like: DataFrame, column: str) -> DataFrame:
        """``(id, f0..)`` of the small side."""
        table = pd.DataFrame(factors, columns=[f"f{f}" for f in range(factors.shape[1])])
        table.insert(0, "id", self.ids)
        kind = like.schema[column].dataType.simpleString()
        return like.sparkSession.createDataFrame(table, ", ".join([f"id {kind}", *(f"f{f} double" for f in range(factors.shape[1]))]))


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places, values = batch.column("places"), batch.column("values")
    row = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
    return places.flatten().to_numpy(), values.flatten().to_numpy(), row


def _product(places: np.ndarray, values: np.ndarray, row: np.ndarray, n: int, factors: np.ndarray) -> np.ndarray:
    """Rows of the matrix times the factors; every row has a cell."""
    if not n or not len(row):
        return np.zeros((n, factors.shape[1]))
    starts = np.searchsorted(row, np.arange(n))
    out = np.empty((n, factors.shape[1]))
    for f in range(factors.shape[1]):  # one factor at a time: what is held is a number a cell, not a row of factors a cell
        out[:, f] = np.add.reduceat(values * factors[places, f], starts)
    return out
