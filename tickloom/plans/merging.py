"""Joins along an ordered axis: as-of, and overlap of consecutive lots.

Both are one union, one shuffle on the key and a running "last seen" value, so
no candidate pairs are formed and a hot key is cut by ``running``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.series import placed, running, unplaced, windowed


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: str = "seq",
    take: Sequence[str] | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """For each left row, the latest right row of its key with right.ts <= left.ts.

    At equal time right rows count as earlier.  ``take`` names the right columns
    to add (all but keys, time and tie if omitted); they are null where nothing
    came before.
    """
    take = list(take or [c for c in right.columns if c not in (*keys, ts, tie)])
    seen = F.struct(*[F.col(c) for c in take])
    mine = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(
        *keys, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(tie).cast("long").alias("_tie"),
        mine.alias("_l"), F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType).alias("_r"),
    )
    b = right.select(
        *keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"),
        F.lit(None).cast(left.select(mine.alias("s")).schema["s"].dataType).alias("_l"), seen.alias("_r"),
    )
    filled = running(
        a.unionByName(b), {"_seen": ("last", F.col("_r"))},
        keys=keys, order=("_t", "_side", "_tie"), rows_per_task=rows_per_task,
    )
    return filled.filter(F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_seen.{c}").alias(c) for c in take])


def overlap_lots(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    end: str = "hi",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Meet two sets of consecutive lots on one axis.

    Each side tiles the axis from 0: a lot reaches from the end of the lot
    before it to its own ``end``.  Returns keys, the structs ``left`` and
    ``right``, and ``overlap``, the length both lots share.
    """
    lt = left.select(F.struct(*[c for c in left.columns if c not in keys]).alias("s")).schema["s"].dataType
    rt = right.select(F.struct(*[c for c in right.columns if c not in keys]).alias("s")).schema["s"].dataType

    def points(df: DataFrame, mine: str, other: str, other_type, side: int) -> DataFrame:
        lot = F.struct(*[c for c in df.columns if c not in keys])
        return df.select(
            *keys, (-F.col(end)).alias("_neg"), F.lit(side).alias("_side"),
            lot.alias(mine), F.lit(None).cast(other_type).alias(other),
        )

    both = points(left, "_l", "_r", rt, 0).unionByName(points(right, "_r", "_l", lt, 1))
    return overlap_points(both, keys=keys, rows_per_task=rows_per_task)


def overlap_points(points: DataFrame, *, keys: Sequence[str] = ("symbol",), rows_per_task: int | None = None) -> DataFrame:
    """``overlap_lots`` for lot ends already in one frame.

    Columns: keys, ``_neg`` (minus the end), ``_side`` (0 left, 1 right) and the
    structs ``_l``, ``_r``, of which one is set.
    """
    # Walking down the axis, the lot covering a stretch is the last end seen.
    order = ("_neg", "_side")
    how = {"keys": keys, "order": order, "rows_per_task": rows_per_task}
    covered = running(
        placed(points, **how), {"left": ("last", F.col("_l")), "right": ("last", F.col("_r"))},
        **how,
    ).drop("_l", "_r")
    cut = windowed(
        covered,
        lambda df, w: df.withColumn(
            "overlap", -F.col("_neg") + F.coalesce(F.lead("_neg", 1).over(w), F.lit(0.0))
        ),
        ahead=1, **how,
    )
    return unplaced(cut).filter(
        F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("overlap") > 0)
    ).select(*keys, "left", "right", "overlap")
