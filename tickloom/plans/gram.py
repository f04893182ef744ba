"""Means and covariances of many columns in one pass, by blocks of a matrix product in each task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 8192


def column_moments(df: DataFrame, columns: Sequence[str], centre: Sequence[float] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance) of the rows in which no column is null.

    Tasks give the sums of their blocks of values less ``centre`` (their first
    row if not given), and Spark joins them pairwise as moments; the driver gets
    columns x columns numbers, whatever the rows.
    """
    p = len(columns)
    given = None if centre is None else np.asarray(centre, dtype=float)
    size = 1 + p + p * p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0.0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            for a in range(0, batch.num_rows, _BLOCK):
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(a, _BLOCK).columns])
                base = x[0] if given is None else given
                y = x - base
                k, total = len(y), y.sum(axis=0)
                own_mean, own_square = base + total / k, y.T @ y - np.outer(total, total) / k
                n, mean, square = _joined((n, mean, square), (k, own_mean, own_square))
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([np.concatenate([[n], mean, square.ravel()])], pa.list_(pa.float64()))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = (0.0, np.zeros(p), np.zeros((p, p)))
        for batch in batches:
            for v in batch.column("part"):
                v = v.values.to_numpy()
                done = _joined(done, (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)))
        if done[0]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([np.concatenate([[done[0]], done[1], done[2].ravel()])], pa.list_(pa.float64()))})

    full = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    parts = full.mapInArrow(run, "part array<double>")
    # A level of the tree between the tasks and the driver, which gets a few parts of p x p numbers.
    merged = parts.repartition(8).mapInArrow(merge, "part array<double>").collect()
    done = (0.0, np.zeros(p), np.zeros((p, p)))
    for row in merged:
        v = np.array(row["part"])
        assert len(v) == size
        done = _joined(done, (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)))
    n, mean, square = done
    return int(n), mean, square / max(n - 1, 1)


def _joined(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if not a[0] else a
    off = b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def distance(columns: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared distance of a row from ``mean`` in the metric ``inverse``; null if a column is."""
    off = F.array(*[F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, mean)])
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in inverse])

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)

    return dot(F.transform(rows, lambda r: dot(r, off)), off)
