"""Time bars, daily statistics and indicators over bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.features import full
from tickloom.plans.decay import Decay, add_decays
from tickloom.plans.series import MIN_ROW_BYTES, ROWS_PER_TASK, UNLIMITED, estimated_bytes, windowed


# Bins that one row may expand to.
BINS_PER_ROW = 1_440


def bin_start(ts: str | Column, seconds: int) -> Column:
    """Start of the bin of ``seconds`` length, counted from the epoch (midnight for divisors of a day)."""
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(seconds * 1_000_000)))


def ohlc(
    df: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), price: str = "price", volume: str = "volume",
    ts: str = "ts", tie: Sequence[str] = ("seq",), fill_empty: bool = True, rows_per_task: int | None = None,
) -> DataFrame:
    """Open, high, low, close, volume, count and VWAP per bin.

    One grouped aggregate with map-side combining.  Empty bins between a key's
    first and last bar are filled from the gap to the next bar, so no calendar
    is joined: null prices, volume 0.  A key has at most (time span / bin) bars;
    if that fits a task, no search for hot keys is made.
    """
    at = F.struct(ts, *tie)
    bars = df.groupBy(*keys, bin_start(ts, seconds).alias("bar")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"),
        F.count("*").alias("trades"),
        F.sum(F.col(price) * F.col(volume)).alias("_notional"),
    ).withColumn("vwap", ratio("_notional", "volume")).drop("_notional")
    if not fill_empty:
        return bars
    step = seconds * 1_000_000

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_next", F.unix_micros(F.lead("bar").over(w)))

    here = F.unix_micros("bar")
    until = F.coalesce(F.col("_next"), here + step)
    most = rows_per_task or ROWS_PER_TASK
    if estimated_bytes(df) >= most * MIN_ROW_BYTES:
        us = F.unix_micros(ts)
        low, high = df.agg(F.min(us), F.max(us)).first()
        if low is None or (high - low) // step + 1 <= most:
            most = UNLIMITED
    # A gap is cut into stretches first, so that no row holds more than one stretch of bins and a long gap is shared by tasks.
    spread = windowed(bars, add, keys=keys, order=("bar",), ahead=1, rows_per_task=most).withColumn("_until", until)
    long_gap = F.col("_until") - here > step * BINS_PER_ROW
    whole = F.lit(step * BINS_PER_ROW)
    cut = spread.filter(long_gap).withColumn("_from", F.explode(F.sequence(here, F.col("_until") - step, whole))).repartition(*keys, "_from")
    spread = spread.filter(~long_gap).withColumn("_from", here).unionByName(cut).withColumn(
        "_bin", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + whole, F.col("_until")) - step, F.lit(step)))
    )
    real = F.col("_bin") == F.unix_micros("bar")
    return spread.select(
        *keys,
        F.timestamp_micros("_bin").alias("bar"),
        *[F.when(real, F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        F.when(real, F.col("volume")).otherwise(F.lit(0.0)).alias("volume"),
        F.when(real, F.col("trades")).otherwise(F.lit(0)).alias("trades"),
        F.when(real, F.col("vwap")).alias("vwap"),
    )


def resample(
    df: DataFrame, seconds: int, columns: Sequence[str], method: str = "last", keys: Sequence[str] = ("symbol",),
    ts: str = "ts", tie: Sequence[str] = ("seq",),
) -> DataFrame:
    """Last known value or mean of each column per bin."""
    at = F.struct(ts, *tie)

    def agg(name: str) -> Column:
        if method == "mean":
            return F.avg(name)
        return F.max_by(name, F.when(F.col(name).isNotNull(), at))

    return df.groupBy(*keys, bin_start(ts, seconds).alias("bar")).agg(*[agg(n).alias(n) for n in columns])


def daily_stats(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Open, high, low, close, volume, trades, return in percent and range per day."""
    day = ohlc(df, 86_400, keys=keys, fill_empty=False)
    return day.select(
        *keys, F.to_date("bar").alias("day"), "open", "high", "low", "close", "volume", "trades",
        (ratio(F.col("close") - F.col("open"), "open") * 100).alias("return_pct"),
        (F.col("high") - F.col("low")).alias("range"),
    )


def classic_indicators(bars: DataFrame, n: int = 14, cci_n: int = 20, keys: Sequence[str] = ("symbol",), **series) -> DataFrame:
    """%K, %D, Williams %R, CCI, ATR and ADX from their textbook formulas (simple means; ADX with Wilder smoothing)."""
    smooth = 1.0 / n
    decays = [Decay(f"_w_{x}", f"_{x}", smooth) for x in ("tr", "plus", "minus")]
    dx = Decay("_w_dx", "_dx", smooth)
    c = F.col

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev, up, down = F.lag("close").over(w), c("high") - F.lag("high").over(w), F.lag("low").over(w) - c("low")
        d = d.withColumns(
            {
                "_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)),
                "_plus": F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)),
                "_minus": F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)),
                "_tp": (c("high") + c("low") + c("close")) / 3,
            }
        )
        top, low = full(F.max, "high", n, w), full(F.min, "low", n, w)
        d = d.withColumns(
            {
                "stoch_k": ratio(c("close") - low, top - low) * 100,
                "williams_r": ratio(top - c("close"), top - low) * -100,
                "atr": full(F.avg, "_tr", n, w),
                "_tp_mean": full(F.avg, "_tp", cci_n, w),
                "_tp_list": F.collect_list("_tp").over(w.rowsBetween(-(cci_n - 1), 0)),
            }
        )
        spread = F.aggregate(
            c("_tp_list"), F.lit(0.0), lambda acc, x: acc + F.abs(x - c("_tp_mean"))
        ) / F.lit(float(cci_n))
        d = d.withColumn("cci", ratio(c("_tp") - c("_tp_mean"), spread * F.lit(0.015)))
        d = d.withColumn("stoch_d", full(F.avg, "stoch_k", 3, w))
        d = add_decays(d, w, decays)
        plus, minus = ratio("_w_plus", "_w_tr"), ratio("_w_minus", "_w_tr")
        d = d.withColumn("_dx", F.coalesce(ratio(F.abs(plus - minus), plus + minus), F.lit(0.0)) * 100)
        d = add_decays(d, w, [dx]).withColumnRenamed("_w_dx", "adx")
        return d.drop("_tr", "_plus", "_minus", "_tp", "_tp_mean", "_tp_list", "_dx", *[x.out for x in decays])

    back = max(n, cci_n) + 4 + decays[0].back + dx.back
    return windowed(bars, add, keys=keys, order=("bar",), back=back, **series)
