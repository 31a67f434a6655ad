"""A self-organising map, trained in batches.

The online rule moves the map after every row, so each step needs the one
before it. The batch rule takes an epoch at once: every row goes to its nearest
unit, rows are summed up by unit, and a unit's new weights are the mean of all
rows, weighted by how near their units are on the grid. That is one aggregate
an epoch, and only the units pass the driver. Both rules pull a unit towards
the rows of its surroundings; the batch rule doesn't depend on the order of
rows and has no learning rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096  # compared with all units at once


def neighbourhood(height: int, width: int, radius: float) -> np.ndarray:
    """How much the rows of one unit count for another: exp(-distance ** 2 / (2 radius ** 2)) on the grid."""
    y, x = np.divmod(np.arange(height * width), width)
    apart = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    return np.exp(-apart / (2 * radius**2))


def _nearest(vectors: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest unit of each vector (of equally near ones the first) and the squared distance, both without cancellation."""
    at, near = [], []
    for i in range(0, len(vectors), ROWS):
        some = vectors[i : i + ROWS]
        apart = np.stack([((some - u) ** 2).sum(axis=1) for u in units], axis=1)
        at.append(apart.argmin(axis=1))
        near.append(apart.min(axis=1))
    return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(near or [np.zeros(0)])


def sums_by_unit(df: DataFrame, vector: str, units: np.ndarray) -> list:
    """(unit, n, sums, error) of every unit with rows. Vectors that are NULL or hold a NULL take no part."""
    shared = df.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        n, sums, error = np.zeros(len(units), np.int64), np.zeros_like(units), np.zeros(len(units))
        for batch in batches:
            if len(batch):
                vectors = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
                at, near = _nearest(vectors, units)
                n += np.bincount(at, minlength=len(units))
                error += np.bincount(at, near, len(units))
                np.add.at(sums, at, vectors)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64())), pa.array(error[some])], ["unit", "n", "sums", "error"])

    whole = df.select(F.col(vector).cast("array<double>").alias("v")).where(f"size(v) = {units.shape[1]} and not exists(v, x -> x is null)")
    partial = whole.mapInArrow(run, "unit long, n long, sums array<double>, error double")
    places = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(units.shape[1])]
    return partial.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), *places).collect()


def epoch(df: DataFrame, vector: str, units: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """New weights of the units, the rows of each, and the mean squared distance of rows from their units before.

    ``weights`` is the ``neighbourhood``; a unit that no row counts for stays.
    """
    n, sums, error = np.zeros(len(units)), np.zeros_like(units), 0.0
    for r in sums_by_unit(df, vector, units):
        n[r.unit], error = r.n, error + r.error
        sums[r.unit] = [r[f"s{i}"] for i in range(units.shape[1])]
    total = weights @ n
    moved = np.where(total[:, None] > 0, weights @ sums / np.maximum(total, 1e-300)[:, None], units)
    return moved, n.astype(np.int64), error / max(1.0, n.sum())


def train(df: DataFrame, vector: str, start: np.ndarray, height: int, width: int, epochs: int = 10, radius: float | None = None) -> tuple[np.ndarray, list[float]]:
    """The trained units of a ``height`` x ``width`` grid, and the mean squared distance before each epoch and after the last.

    The radius falls from ``radius`` (half the longer side) to a half in equal factors.
    """
    first = max(radius or max(height, width) / 2, 0.5)
    units, errors = np.array(start, float), []
    for e in range(epochs):
        r = first * (0.5 / first) ** (e / max(1, epochs - 1))
        units, _, error = epoch(df, vector, units, neighbourhood(height, width, r))
        errors.append(error)
    found = sums_by_unit(df, vector, units)
    errors.append(sum(r.error for r in found) / max(1, sum(r.n for r in found)))
    return units, errors
