"""Decayed sums and maxima over the rows that are live at each time, by a sweep over enter and leave times.

A row enters at its time and leaves at a time of its own; while it is live its
value decays with its age.  With values scaled to the start of their group, the
sum over live rows is the sum of those that have entered less the sum of those
that have left, whatever their number, and the largest is found by laying each
row's span of times out as two blocks whose length is a power of two.  The work
grows as n log n with the rows of a group, not with the rows live at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.plans.thinning import key_changes


def range_max(first: np.ndarray, end: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each place below ``n`` the largest value of the spans [first, end) that cover it; -inf where none does."""
    real = end > first
    first, end, value = first[real], end[real], value[real]
    level = np.frexp((end - first).astype(float))[1] - 1  # the largest power of two inside a span
    out = np.full(n, -np.inf)
    for k in range(int(level.max(initial=0)), -1, -1):
        own = level == k
        np.maximum.at(out, first[own], value[own])
        np.maximum.at(out, end[own] - (1 << k), value[own])
        if k:
            # Blocks of 2^k are two of half the length.
            half = 1 << (k - 1)
            low = out.copy()
            low[half:] = np.maximum(low[half:], out[:-half] if half < n else out[:0])
            out = low
    return out


def live_sums(group: np.ndarray, enter: np.ndarray, leave: np.ndarray, parts: Sequence[np.ndarray], rates: Sequence[float], peak: np.ndarray, rate: float):
    """Of rows sorted by (group, enter): (row of each distinct time, rows live, sums of ``parts``, largest ``peak``).

    A part shrinks by exp(rate * age); a row is live from ``enter`` until just
    before ``leave``, which may be no later than ``enter`` (never live).  Times are
    whole numbers, rates are of one unit of time and not positive.
    """
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (enter[1:] != enter[:-1])])
    at = np.flatnonzero(new)
    time, of = enter[at], group[at]
    begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    origin = np.repeat(time[begins], np.diff(np.append(begins, len(of))))
    row_time = np.cumsum(new) - 1
    zero = origin[row_time]
    # Where each row leaves among the distinct times of its own group.
    span = int((enter - zero).max(initial=0)) + 2
    axis = of.astype(np.int64) * span + (time - origin)
    out_at = np.searchsorted(axis, group.astype(np.int64) * span + np.clip(leave - zero, 0, span - 1), side="left")
    live = out_at > row_time
    first, end = row_time[live], out_at[live]
    which = np.cumsum(np.concatenate([[False], of[1:] != of[:-1]]))
    ends_of = np.append(begins[1:], len(of))[which[first]]

    def swept(values: np.ndarray) -> np.ndarray:
        steps = np.bincount(first, weights=values, minlength=len(at)).astype(float)
        # What never leaves inside its group is not taken off.
        inside = end < ends_of
        steps -= np.bincount(end[inside], weights=values[inside], minlength=len(at))
        return pd.Series(steps).groupby(of).cumsum().to_numpy()

    ages = (time - origin).astype(float)
    row_ages = (enter - zero).astype(float)[live]
    count = np.rint(swept(np.ones(len(first))))
    sums = [swept(p[live] * np.exp(-r * row_ages)) * np.exp(r * ages) for p, r in zip(parts, rates)]
    top = range_max(first, end, np.log(np.maximum(peak[live], 1e-300)) - rate * row_ages, len(at))
    largest = np.exp(top + rate * ages)
    return at, count.astype(np.int64), sums, np.where(count > 0, largest, np.nan)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole groups, number of the group of each row) of batches sorted by ``keys``; the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def given(rows: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        all_rows = pa.Table.from_batches(rows).combine_chunks()
        return all_rows, np.cumsum(key_changes(all_rows, keys)) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(key_changes(batch, keys))[-1])
        if held and last == 0 and [held[-1].column(k)[-1] for k in keys] == [batch.column(k)[0] for k in keys]:
            held.append(batch)
            continue
        if last or held:
            ready = [*held, batch.slice(0, last)] if last else held
            yield given(ready)
        held = [batch.slice(last)]
    if held:
        yield given(held)


def by_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], run, schema: str) -> DataFrame:
    """``run(rows, group numbers)`` over whole groups of ``keys``, sorted by ``order`` inside, many groups at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, keys):
            yield from run(rows, group).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)
