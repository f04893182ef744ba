"""The recurrence y[t] = a[t] * y[t-1] + b[t] with coefficients known per row.

Two steps compose into one step of the same form.  A task takes its sorted rows
in Arrow batches, composes each batch by doubling, holding one pair (a, b) per running key, so no key is ever
collected.  A hot key is cut into blocks: each block is walked from an unknown
start, the blocks' totals are chained, and the start is put in afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.series import RANK, split_hot

_PARTS = ("__ca", "__cb", "__pa", "__pb")


def _composed(a: np.ndarray, b: np.ndarray, new: np.ndarray, start: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs composed up to each row by doubling the reach; ``new`` rows start afresh, the others from ``start``."""
    A, B, closed = a.astype(float).copy(), b.astype(float).copy(), new.copy()
    reach = 1
    while reach < len(A):
        open_ = np.flatnonzero(~closed[reach:]) + reach
        if not len(open_):
            break
        x, y, done = A[open_ - reach], B[open_ - reach], closed[open_ - reach]
        B[open_] += A[open_] * y
        A[open_] *= x
        closed[open_] = done
        reach *= 2
    first = ~np.maximum.accumulate(new)
    B[first] += A[first] * start[1]
    A[first] *= start[0]
    return A, B


def _walk(df: DataFrame, a: str, b: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the composed pair up to each row (__ca, __cb) and up to the row before (__pa, __pb)."""
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in _PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, A, B = None, 1.0, 0.0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            new = np.zeros(n, dtype=bool)
            for k in group:
                col = batch.column(k)
                if n > 1:
                    new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = last != tuple(batch.column(k)[0].as_py() for k in group)
            last = tuple(batch.column(k)[n - 1].as_py() for k in group)
            out = np.empty((4, n))
            out[0], out[1] = _composed(
                batch.column(a).to_numpy(zero_copy_only=False), batch.column(b).to_numpy(zero_copy_only=False), new, (A, B)
            )
            out[2], out[3] = np.concatenate([[A], out[0, :-1]]), np.concatenate([[B], out[1, :-1]])
            out[2, new], out[3, new] = 1.0, 0.0
            A, B = out[0, -1], out[1, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in out]], names=[*batch.schema.names, *_PARTS])

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def recurrence(
    df: DataFrame,
    a: str,
    b: str,
    out: str,
    *,
    before: str | None = None,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "seq"),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``out`` following the recurrence from y = 0, and its value one row earlier as ``before``.

    Keys must not be null; coefficients are doubles.
    """
    names = [F.col(c) for c in df.columns]

    def finish(d: DataFrame, start) -> DataFrame:
        cols = [(F.col("__cb") + F.col("__ca") * start).alias(out)]
        if before:
            cols.append((F.col("__pb") + F.col("__pa") * start).alias(before))
        return d.select(*names, *cols)

    cold, rows, block, _ = split_hot(df, keys, order, rows_per_task)
    plain = None if cold is None else finish(_walk(cold, a, b, keys, order), F.lit(0.0))
    if rows is None:
        return plain
    rows = rows.withColumn("__blk", F.floor(F.col(RANK) / block))
    group = [*keys, "__blk"]
    walked = _walk(rows, a, b, group, [RANK])
    # One pair per block of rows_per_task rows; the chain over them is short.
    totals = walked.groupBy(*group).agg(F.max_by(F.struct("__ca", "__cb"), RANK).alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"__s{k}") for k in group],
        F.aggregate(
            F.collect_list("__t").over(earlier), F.lit(0.0), lambda y, t: t["__ca"] * y + t["__cb"]
        ).alias("__start"),
    )
    match = reduce(lambda x, y: x & y, [walked[k].eqNullSafe(starts[f"__s{k}"]) for k in group])
    filled = finish(walked.join(F.broadcast(starts), match), F.col("__start"))
    return filled if plain is None else plain.unionByName(filled)
