"""Cleaning of tick series: de-duplication, outliers, repair of times and prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import quotient
from tickloom.plans.series import broadcast_if_small, quantiles, running, windowed
from tickloom.plans.thinning import thinned


def keep_last(df: DataFrame, keys: Sequence[str] = ("symbol", "ts"), tie: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per key, the last in ``tie`` order.

    A rank filter of 1 is applied inside each task before the shuffle, so a key
    with very many copies sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in tie])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def signature_dedup(
    df: DataFrame, signature: Sequence[str], horizon_seconds: float, order: Sequence[str] = ("ts", "seq"), ts: str = "ts",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Drop a row if the last kept row of its signature is at most ``horizon_seconds`` earlier.

    ``order`` decides which of several rows of one time comes first.
    """
    return thinned(df, list(signature), horizon_seconds, order=list(order), ts=ts, rows_per_task=rows_per_task)


def price_level(df: DataFrame, tick: float, price: str = "price", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Whole ticks above the lowest price of the series."""
    low = broadcast_if_small(df.groupBy(*keys).agg(F.min(price).alias("_low")))
    level = F.floor((F.col(price) - F.col("_low")) / F.lit(tick) + F.lit(1e-9))
    return df.join(low, list(keys)).withColumn("level", level).drop("_low")


def recent_mean_outlier(
    df: DataFrame, price: str = "price", count: int = 50, least: int = 5, share: float = 0.05, **series
) -> DataFrame:
    """Flag a price more than ``share`` away from the mean of the ``count`` rows before it."""

    def add(d, w):
        before = w.rowsBetween(-count, -1)
        mean = F.avg(price).over(before)
        seen = F.count("*").over(before)
        far = (seen >= least) & (F.abs(F.col(price) - mean) > F.lit(share) * F.abs(mean))
        return d.select("*", mean.alias("recent_mean"), F.coalesce(far, F.lit(False)).alias("is_outlier"))

    return windowed(df, add, back=count, **series)


def clean_price_series(
    df: DataFrame, price: str = "price", sigmas: float = 5.0, least: int = 10, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Positive finite prices within ``sigmas`` population deviations (series of more than ``least`` rows)."""
    ok = df.filter((F.col(price) > 0) & (F.col(price) < F.lit(float("inf"))))
    stats = broadcast_if_small(
        ok.groupBy(*keys).agg(
            F.avg(price).alias("_mean"), F.stddev_pop(price).alias("_sd"), F.count("*").alias("_n")
        )
    )
    near = F.abs(F.col(price) - F.col("_mean")) <= F.lit(sigmas) * F.col("_sd")
    return ok.join(stats, list(keys)).filter((F.col("_n") <= least) | near).drop("_mean", "_sd", "_n")


def interpolate_time(
    df: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",), order: str = "seq", rows_per_task: int | None = None
) -> DataFrame:
    """Fill null times on the line between the nearest known ones, by the numeric ``order`` column."""
    known = F.when(F.col(ts).isNotNull(), F.struct(F.unix_micros(ts).alias("us"), F.col(order).alias("at")))
    back = running(df, {"_lo": ("last", known)}, keys=keys, order=(order,), rows_per_task=rows_per_task)
    turned = back.withColumn("_turn", -F.col(order))
    both = running(turned, {"_hi": ("last", known)}, keys=keys, order=("_turn",), rows_per_task=rows_per_task)
    lo, hi = F.col("_lo"), F.col("_hi")
    share = (F.col(order) - lo["at"]) / (hi["at"] - lo["at"])
    between = F.floor(lo["us"] + (hi["us"] - lo["us"]).cast("double") * share).cast("long")
    us = F.when(lo.isNull(), hi["us"]).when(hi.isNull(), lo["us"]).otherwise(between)
    filled = F.coalesce(F.col(ts), F.timestamp_micros(us))
    return both.withColumn(ts, filled).drop("_lo", "_hi", "_turn")


def tradeable(df: DataFrame, assets: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Whether the asset's status is trading and the time is inside its hours."""
    h = F.hour(ts)
    inside = (F.col("status") == "trading") & (h >= F.col("open_hour")) & (h < F.col("close_hour"))
    return df.join(broadcast_if_small(assets), list(keys)).withColumn("tradeable", inside)


def median_filter(df: DataFrame, price: str = "price", sigmas: float = 2.0, **series) -> DataFrame:
    """Replace a price far off the centred five-row median by that median; edges are kept."""

    def add(d, w):
        five = w.rowsBetween(-2, 2)
        mid, sd = F.percentile(price, F.lit(0.5)).over(five), F.stddev_pop(price).over(five)
        swap = (F.count(price).over(five) == 5) & (F.abs(F.col(price) - mid) > F.lit(sigmas) * sd)
        return d.withColumn("filtered", F.when(swap, mid).otherwise(F.col(price)))

    return windowed(df, add, back=2, ahead=2, **series)


def winsorise_returns(
    df: DataFrame, price: str = "price", low: float = 0.05, high: float = 0.95, keys: Sequence[str] = ("symbol",), **series
) -> DataFrame:
    """Rebuild a price whose return is outside the quantiles from the previous raw price.

    The return after a price of zero is infinite, and so outside them.
    """

    def add(d, w):
        return d.withColumn("_prev", F.lag(price).over(w))

    prev = windowed(df, add, back=1, keys=keys, **series).withColumn("_ret", quotient(price, "_prev") - 1)
    bounds = quantiles(prev, "_ret", {"_q_lo": low, "_q_hi": high}, keys=keys, rows_per_task=series.get("rows_per_task"))
    r = F.col("_ret")
    fixed = (
        F.when(r < F.col("_q_lo"), F.col("_prev") * (1 + F.col("_q_lo")))
        .when(r > F.col("_q_hi"), F.col("_prev") * (1 + F.col("_q_hi")))
        .otherwise(F.col(price))
    )
    return (
        prev.join(broadcast_if_small(bounds), list(keys), "left").withColumn("winsorised", fixed)
        .drop("_prev", "_ret", "_q_lo", "_q_hi")
    )
