"""Ordered per-key computation that does not depend on how rows spread over keys.

``Window.partitionBy(key)`` sends every row of a key to one task.  That is the
right plan for ordinary keys and the wrong one for a key that holds a third of
the table.  The functions here keep the plain window for ordinary keys and cut
only the hot ones into blocks of consecutive rows:

* ``windowed``  - frames that look a bounded number of rows back or ahead; each
  block also receives that many neighbouring rows.
* ``running``   - frames that reach back to the first row; each block is folded
  on its own and the totals of the earlier blocks are added.
* ``quantiles`` - exact interpolated quantiles, read off at their rank.

``placed`` finds and numbers the rows of hot keys once for several such steps.
A table too small to hold a hot key is recognised from the optimizer's size
estimate, without running a job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import durable

ROWS_PER_TASK = 4_000_000
# A table estimated below rows_per_task * this value fits one task even if all of
# it is one key, so it is not searched for hot keys.
MIN_ROW_BYTES = 4
BROADCAST_BYTES = 64 * 1024 * 1024
RANK = "__rn"
# As rows_per_task: the caller knows that no key is hot.
UNLIMITED = 2**60


def estimated_bytes(df: DataFrame) -> int:
    """Size the optimizer expects ``df`` to have (an upper figure from file sizes)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the estimated size is under ``limit``; else leave the join to AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spec(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


@dataclass(frozen=True)
class HotKeys:
    """Keys holding more than ``block`` rows: at most (all rows / block) of them."""

    keys: tuple[str, ...]
    table: DataFrame
    rows: int
    block: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not self.keys:
            return df.limit(0), df
        listed = F.broadcast(self.table)
        same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(listed[f"__k_{k}"]) for k in self.keys))
        return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> HotKeys | None:
    """Find keys with more than ``rows_per_task`` rows, or None when there are none."""
    block = rows_per_task or ROWS_PER_TASK
    if estimated_bytes(df) < block * MIN_ROW_BYTES:
        return None
    heavy = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > block)
    # The list is bounded: every entry stands for more than `block` rows.
    found = heavy.collect()
    if not found:
        return None
    renamed = heavy.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    listed = df.sparkSession.createDataFrame(
        [tuple(r[k] for k in keys) for r in found], renamed.schema
    ) if keys else df.sparkSession.range(1)
    return HotKeys(tuple(keys), listed, sum(r["__n"] for r in found), block)


def place(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: int, rows: int) -> DataFrame:
    """Add ``__rn``, the 0-based position of a row inside its key, without one task per key.

    Rows are range-partitioned and sorted on (key, order), so a large key spans
    many partitions.  The position is the offset inside the partition plus the
    row counts of the key's earlier partitions; those counts are one row per
    (key, partition) and so bounded by partitions + keys.
    """
    parts = max(1, -(-rows // block))
    if rows <= 0:
        parts = 1
    sorted_rows = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__pid", F.shiftright("__mid", 33))
    )
    # The range bounds come from a sample: fix the placement before reading it twice.
    stored = durable(sorted_rows)
    starts = (
        stored.groupBy(*keys, "__pid")
        .agg(F.min("__mid").alias("__first"), F.count("*").alias("__n"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__n").over(
                    Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col("__pid").alias("__s_pid"), "__first", "__before")
    )
    match = reduce(
        lambda a, b: a & b,
        [stored[k].eqNullSafe(starts[f"__s_{k}"]) for k in keys],
        stored["__pid"] == starts["__s_pid"],
    )
    return (
        stored.join(F.broadcast(starts), match)
        .withColumn("__rn", F.col("__mid") - F.col("__first") + F.col("__before"))
        .drop("__mid", "__pid", "__s_pid", "__first", "__before", *[f"__s_{k}" for k in keys])
    )


def placed(
    df: DataFrame, *, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), rows_per_task: int | None = None
) -> DataFrame:
    """Settle once, for a chain of ``windowed`` and ``running`` steps on one key and order,
    which rows belong to hot keys and where they stand.

    The steps recognise the column this adds; end the chain with ``unplaced``.
    """
    if RANK in df.columns or estimated_bytes(df) < (rows_per_task or ROWS_PER_TASK) * MIN_ROW_BYTES:
        return df
    cold, rows, _, _ = split_hot(df, keys, order, rows_per_task)
    parts = [] if cold is None else [cold.withColumn(RANK, F.lit(None).cast("long"))]
    if rows is not None:
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def unplaced(df: DataFrame) -> DataFrame:
    return df.drop(RANK)


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None
) -> tuple[DataFrame | None, DataFrame | None, int, bool]:
    """Rows of ordinary keys, numbered rows of hot keys, block length, and whether to keep the numbers."""
    block = rows_per_task or ROWS_PER_TASK
    if RANK in df.columns:
        return df.filter(F.col(RANK).isNull()), df.filter(F.col(RANK).isNotNull()), block, True
    hot = hot_keys(df, keys, rows_per_task)
    if hot is None:
        return df, None, block, False
    cold, heavy = hot.split(df)
    return (cold if hot.keys else None), place(heavy, keys, order, block, hot.rows), block, False


def windowed(
    df: DataFrame,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "seq"),
    back: int = 0,
    ahead: int = 0,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Apply ``add(df, window)``; its frames may reach ``back`` rows behind and ``ahead`` rows on.

    ``add`` adds columns and keeps all it is given.
    """
    cold, rows, block, keep = split_hot(df, keys, order, rows_per_task)
    plain = None if cold is None else add(cold, spec(keys, order))
    if rows is None:
        return plain
    block = max(block, back, ahead, 1)
    offset = F.col(RANK) % block
    home = F.floor(F.col(RANK) / block)
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= block - back, home + 1),
            F.when((offset < ahead) & (home > 0), home - 1),
        )
    )
    spread = rows.withColumn("__home", home).withColumn("__at", F.explode(targets))
    done = add(spread, Window.partitionBy(*keys, "__at").orderBy(RANK))
    kept = done.filter(F.col("__at") == F.col("__home")).drop("__home", "__at")
    kept = kept if keep else kept.drop(RANK)
    return kept if plain is None else plain.unionByName(kept)


_FOLD = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}


def _over(kind: str, value: Column, frame: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return _FOLD[kind](value).over(frame)


def _joined(kind: str, own: Column, carried: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(own.isNull() & carried.isNull(), F.lit(None)).otherwise(
            F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
        )
    if kind == "max":
        return F.greatest(own, carried)
    if kind == "min":
        return F.least(own, carried)
    return F.coalesce(own, carried)


def running(
    df: DataFrame,
    values: Mapping[str, tuple[str, Column]],
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "seq"),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add running values from the first row of a key up to the current row.

    ``values`` maps an output name to ``(kind, expression)``; the kind is one of
    sum, count, max, min, last (last non-null).
    """
    cold, rows, block, keep = split_hot(df, keys, order, rows_per_task)
    plain = None
    if cold is not None:
        frame = spec(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        plain = cold.select("*", *[_over(k, v, frame).alias(n) for n, (k, v) in values.items()])
    if rows is None:
        return plain
    rows = rows.withColumn("__blk", F.floor(F.col(RANK) / block))
    totals = rows.groupBy(*keys, "__blk").agg(
        *[
            (
                F.max_by(v, F.when(v.isNotNull(), F.col("__rn"))) if k == "last" else _FOLD[k](v)
            ).alias(f"__t_{n}")
            for n, (k, v) in values.items()
        ]
    )
    # One row per block, so this window is over (rows / block) rows.
    earlier = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__c_{k}") for k in keys],
        F.col("__blk").alias("__c_blk"),
        *[
            _over("sum" if k == "count" else k, F.col(f"__t_{n}"), earlier).alias(f"__c_{n}")
            for n, (k, v) in values.items()
        ],
    )
    match = reduce(
        lambda a, b: a & b,
        [rows[k].eqNullSafe(carry[f"__c_{k}"]) for k in keys],
        rows["__blk"] == carry["__c_blk"],
    )
    frame = Window.partitionBy(*keys, "__blk").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        rows.join(F.broadcast(carry), match, "left")
        .select(
            *[rows[c] for c in df.columns],
            *[
                _joined(k, _over(k, v, frame), F.col(f"__c_{n}")).alias(n)
                for n, (k, v) in values.items()
            ],
        )
    )
    return merged if plain is None else plain.unionByName(merged)


def numbered(
    df: DataFrame,
    name: str = "pos",
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "seq"),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its key (``row_number`` without a hot task)."""
    return running(
        df, {name: ("count", F.lit(1))}, keys=keys, order=order, rows_per_task=rows_per_task
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    *,
    keys: Sequence[str] = ("symbol",),
    rows_per_task: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: one output column per entry of ``probs``.

    ``percentile`` holds a value map per group in one task.  Of a hot key equal
    values are counted first, each task's own before the shuffle, and the distinct
    ones are accumulated in order; the two neighbouring ranks are picked, so many
    ties are one row.
    """
    present = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    direct = [F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()]
    hot = hot_keys(present, keys, rows_per_task)
    if hot is None:
        return present.groupBy(*keys).agg(*direct)
    if not hot.keys:
        found = _narrowed(present, probs, hot.rows)
        if found is not None:
            return found
    cold, heavy = hot.split(present)
    counted = heavy.groupBy(*keys, "_v").agg(F.count("*").alias("__c"))
    upto = running(counted, {"__upto": ("sum", F.col("__c"))}, keys=keys, order=["_v"], rows_per_task=rows_per_task)
    sizes = counted.groupBy(*[F.col(k).alias(f"__s{k}") for k in keys]).agg(F.sum("__c").alias("__n"))
    match = [upto[k].eqNullSafe(sizes[f"__s{k}"]) for k in keys]
    near = upto.join(broadcast_if_small(sizes), reduce(lambda a, b: a & b, match, F.lit(True)))
    picks = []
    for n, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(p)
        low = F.floor(at)
        first, last = F.col("__upto") - F.col("__c"), F.col("__upto") - 1  # ranks from 0 that the value has
        share = F.when(low.between(first, last), 1.0 - (at - low)).otherwise(F.lit(0.0)) + F.when(
            (low + 1).between(first, last), at - low
        ).otherwise(F.lit(0.0))
        picks.append(F.sum(F.when(share > 0, share * F.col("_v"))).alias(n))
    result = near.groupBy(*keys).agg(*picks)
    if not hot.keys:
        return result
    return cold.groupBy(*keys).agg(*direct).unionByName(result)


# Ranks to both sides of a quantile, as a share of the rows, that its bracket is to hold.
BRACKET = 5e-4


def _narrowed(present: DataFrame, probs: Mapping[str, float], rows: int) -> DataFrame | None:
    """Exact quantiles of the whole column ``_v`` by sorting only values near them: one row, or None.

    A sketch gives a bracket, exact counts tell the ranks that lie in it, and the
    distinct values of the bracket are accumulated, a small share of the rows.  None
    where a bracket misses its ranks: the caller then sorts all values.
    """
    sides = [x for p in probs.values() for x in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    ends = present.agg(F.percentile_approx("_v", sides, 10_000).alias("q")).first()["q"]
    brackets = list(zip(ends[::2], ends[1::2]))
    v = F.col("_v")
    counts = present.agg(*[x for i, (a, b) in enumerate(brackets) for x in (F.count_if(v < F.lit(a)).alias(f"b{i}"), F.count_if(v <= F.lit(b)).alias(f"u{i}"))]).first()
    picks = []
    for i, ((a, b), (n, p)) in enumerate(zip(brackets, probs.items())):
        at = (rows - 1) * p
        low = int(at)
        if not (counts[f"b{i}"] <= low and min(low + 1, rows - 1) < counts[f"u{i}"]):
            return None
        near = present.filter((v >= F.lit(a)) & (v <= F.lit(b))).groupBy("_v").agg(F.count("*").alias("_c"))
        upto = F.lit(counts[f"b{i}"]) + F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        held = near.withColumn("_upto", upto)
        first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
        share = F.when(F.lit(low).between(first, last), 1.0 - (at - low)).otherwise(0.0) + F.when(F.lit(low + 1).between(first, last), at - low).otherwise(0.0)
        picks.append(held.agg(F.sum(F.when(share > 0, share * v)).alias(n)))
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), picks)


def time_windowed(
    df: DataFrame,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    seconds_back: float,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    cell_seconds: float = 3600.0,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Frames over a span of time, one task per (key, time cell) in place of one per key.

    The window handed to ``add`` is ordered by epoch microseconds (``_us``), so
    ``rangeBetween`` takes microseconds.  See ``time_cells``.
    """
    spread = time_cells(df, seconds_back=seconds_back, keys=keys, ts=ts, cell_seconds=cell_seconds, rows_per_task=rows_per_task)
    done = add(spread, Window.partitionBy(*keys, "__at").orderBy("_us"))
    return done.filter(F.col("__at") == F.col("__home")).drop("__home", "__at", "_us")


def time_cells(
    df: DataFrame, *, seconds_back: float, keys: Sequence[str] = ("symbol",), ts: str = "ts", cell_seconds: float = 3600.0, rows_per_task: int | None = None
) -> DataFrame:
    """Rows with their epoch microseconds (``_us``), the cell of the time axis they are in (``__home``) and one that sees them (``__at``).

    Rows in the last ``seconds_back`` of a cell are also seen by the next cell.
    Where the table is large the fullest cell is measured and cells shrink to fit,
    down to the span.
    """
    span, cell = int(seconds_back * 1e6), int(max(cell_seconds, seconds_back) * 1e6)
    us = F.unix_micros(F.col(ts))
    most = rows_per_task or ROWS_PER_TASK
    if estimated_bytes(df) >= most * MIN_ROW_BYTES:
        fullest = df.groupBy(*keys, F.floor(us / cell)).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
        if fullest > most:
            cell = max(span, cell * most // fullest)
    home = F.floor(us / cell)
    return (
        df.withColumn("_us", us)
        .withColumn("__home", home)
        .withColumn(
            "__at",
            F.explode(F.array_compact(F.array(home, F.when(us - home * cell >= cell - span, home + 1)))),
        )
    )
