"""Aggregates of the last n rows at a cost that does not grow with n.

The rows of a key are cut into runs of n.  The last n rows at any place are the
tail of one run and the head of the next, so the aggregates of all heads and all
tails give every frame: two values are joined for each row, whatever n is.
Nothing is ever taken off a sum, so there is no cancellation; means and
deviations are kept against a value of their own run and joined as moments.  The
median keeps the frame's values in order (pandas' skip list).

Rows come in Arrow batches, sorted by a window over the key; between batches the
last n - 1 values of a key are carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("avg", "sum", "min", "max", "stddev_samp", "stddev_pop", "median")
_POS = "__pos"


def _runs(v: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``n`` values; the last one is filled up with its own last value."""
    return np.pad(v, (0, -len(v) % n), mode="edge").reshape(-1, n)


def _joined(heads: np.ndarray, tails: np.ndarray, size: int, n: int, join) -> np.ndarray:
    """At each place from n - 1 on, the frame's tail of the run before joined with the head of its own run."""
    at = np.arange(n - 1, size)
    head, begin = heads.ravel()[at], at - n + 1
    # A frame that is a whole run has no tail.
    return np.where(begin % n == 0, head, join(tails.ravel()[begin], head))


def sliding(v: np.ndarray, kind: str, n: int) -> np.ndarray:
    """The aggregate of the n values up to each place; the first n - 1 places are NaN."""
    out = np.full(len(v), np.nan)
    if len(v) < n:
        return out
    if kind == "median":
        return pd.Series(v).rolling(n, min_periods=n).median().to_numpy()
    runs = _runs(v, n)
    if kind in ("min", "max"):
        best = np.minimum if kind == "min" else np.maximum
        out[n - 1 :] = _joined(best.accumulate(runs, axis=1), best.accumulate(runs[:, ::-1], axis=1)[:, ::-1], len(v), n, best)
        return out
    if kind == "sum":
        out[n - 1 :] = _joined(runs.cumsum(axis=1), runs[:, ::-1].cumsum(axis=1)[:, ::-1], len(v), n, np.add)
        return out
    base = runs[:, :1]
    off = runs - base
    counts = np.arange(1.0, n + 1)
    head, tail = off.cumsum(axis=1), off[:, ::-1].cumsum(axis=1)[:, ::-1]
    at = np.arange(n - 1, len(v))
    begin = at - n + 1
    whole = begin % n == 0
    base = np.broadcast_to(base, runs.shape).ravel()
    na, nb = np.where(whole, 0.0, n - begin % n), at % n + 1.0
    mean_b = head.ravel()[at] / nb + base[at]
    mean_a = np.divide(tail.ravel()[begin], na, out=np.zeros(len(at)), where=na > 0) + base[begin]
    between = np.where(whole, 0.0, mean_b - mean_a)
    if kind == "avg":
        out[n - 1 :] = np.where(whole, mean_b, mean_a + between * nb / n)
        return out
    square_head = (off**2).cumsum(axis=1) - head**2 / counts
    square_tail = (off**2)[:, ::-1].cumsum(axis=1)[:, ::-1] - tail**2 / counts[::-1]
    total = square_head.ravel()[at] + np.where(whole, 0.0, square_tail.ravel()[begin]) + between**2 * na * nb / n
    out[n - 1 :] = np.sqrt(np.maximum(total, 0.0) / (n if kind == "stddev_pop" else max(n - 1, 1)))
    if kind == "stddev_samp" and n == 1:
        out[:] = np.nan
    return out


def add_sliding(df: DataFrame, w: WindowSpec, wanted: Mapping[str, tuple[str, str, int]]) -> DataFrame:
    """Add columns ``name: (kind, double column, n)`` over the last n rows of ``w``; null until n values without a null are there.

    The window's row number places the rows of a key side by side and in order;
    the walk over them checks that it goes up by one.
    """
    placed = df.withColumn(_POS, F.row_number().over(w))
    schema = T.StructType([*placed.schema.fields, *[T.StructField(name, T.DoubleType()) for name in wanted]])
    reach = {x: max(n for _, y, n in wanted.values() if y == x) - 1 for _, x, _ in wanted.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = {x: np.zeros(0) for x in reach}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column(_POS).to_numpy()
            if pos[0] not in (1, last + 1) or not ((pos[1:] == pos[:-1] + 1) | (pos[1:] == 1)).all():
                raise RuntimeError("rows of a key are not side by side")
            values = {x: batch.column(x).to_numpy(zero_copy_only=False).astype(float) for x in reach}
            before = {x: carried[x] if pos[0] != 1 else np.zeros(0) for x in reach}
            joint = {x: np.concatenate([before[x], values[x]]) for x in reach}
            columns = list(batch.columns)
            for kind, x, n in wanted.values():
                v, skip = joint[x], len(before[x])
                gap = np.isnan(v)
                gaps = np.cumsum(gap)
                # Values that are missing take no part: their frames are null.
                got = sliding(np.where(gap, 0.0, v), kind, n)[skip:]
                upto = np.concatenate([np.zeros(n, dtype=gaps.dtype), gaps])[: len(v)][skip:]
                ok = (pos >= n) & (gaps[skip:] == upto)
                columns.append(pa.array(got, mask=~ok | np.isnan(got)))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *wanted])
            last = int(pos[-1])
            for x, k in reach.items():
                own = joint[x][max(0, len(joint[x]) - k) :] if k else np.zeros(0)
                carried[x] = own[max(0, len(own) - last) :]

    return placed.mapInArrow(run, schema).drop(_POS)
