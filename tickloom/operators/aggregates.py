"""Report aggregates: trade statistics, counts, histograms, percentiles, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.plans.pairs import centred_moments, pair_stats
from tickloom.plans.series import numbered, quantiles, windowed


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def trade_stats(df: DataFrame, keys: Sequence[str] = (), pnl: str = "pnl") -> DataFrame:
    """Counts, sizes, win rate, profit factor, extremes, activity per key (or one row).

    The busiest hour comes from counts per hour, summed before the shuffle; ties
    go to the earliest hour.
    """
    p, v = F.col(pnl), F.col("volume")
    won, lost = F.when(p > 0, p), F.when(p < 0, p)
    days = F.greatest(F.datediff(F.max("ts"), F.min("ts")), F.lit(1))
    hour = F.hour("ts")
    # First per hour, so that hours are counted without a distinct aggregate.
    main = df.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.sum(v).alias("total_volume"), F.avg(v).alias("average_trade_size"),
        F.max(v).alias("largest_trade"), F.min(v).alias("smallest_trade"),
        (F.count(won) / F.count("*") * 100).alias("win_rate"),
        F.abs(F.try_divide(F.sum(won), F.sum(lost))).alias("profit_factor"),
        _zero(F.avg(won)).alias("average_win"), _zero(F.avg(lost)).alias("average_loss"),
        _zero(F.max(won)).alias("largest_win"), _zero(F.min(lost)).alias("largest_loss"),
        (F.count("*") / days).alias("trades_per_day"),
    )
    hours = df.groupBy(*keys, hour.alias("_hour")).agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.max_by("_hour", F.struct("_n", -F.col("_hour"))).alias("most_active_hour"), F.count("*").alias("trading_hours_spread")
    )
    return main.join(hours, list(keys)) if keys else main.crossJoin(F.broadcast(hours))


def volume_pattern(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **series) -> DataFrame:
    """Trend of volume against row number (0.1 correlation either way) and its coefficient of variation."""
    placed = numbered(df, "_pos", keys=keys, order=order, **series)
    n, x = F.col("volume"), F.col("_pos").cast("double")
    out = placed.groupBy(*keys).agg(
        ratio(F.covar_pop(n, x), F.stddev_pop(n) * F.stddev_pop(x)).alias("volume_corr"),
        ratio(F.stddev_samp(n), F.avg(n)).alias("volume_cv"),
    )
    r = F.col("volume_corr")
    return out.withColumn("volume_trend", F.when(r > 0.1, "increasing").when(r < -0.1, "decreasing").otherwise("stable"))


def top_counts(df: DataFrame, by: Column, k: int, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent values with their share in percent; ties by value."""
    counts = df.groupBy(*keys, by.alias("value")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
        top = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r").join(total, list(keys))
    else:
        top = counts.orderBy(F.desc("n"), "value").limit(k).crossJoin(F.broadcast(total))
    return top.select(*keys, F.lit(label).alias("what"), F.col("value").cast("string").alias("value"), "n", (F.col("n") / F.col("_all") * 100).alias("share"))


def hourly_counts(df: DataFrame, ts: str = "ts", of_day: bool = False) -> DataFrame:
    at = F.hour(ts) if of_day else F.date_trunc("hour", ts)
    return df.groupBy(at.alias("hour")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the largest falls in the last bin."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), width), F.lit(0.0))
    return (
        df.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor(at), F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def latency_percentiles(df: DataFrame, latency: str = "latency_ms", keys: Sequence[str] = (), approximate: bool = False, rows_per_task: int | None = None) -> DataFrame:
    """Mean, p50, p95, p99 and maximum; ``approximate`` trades exactness for a bounded sketch per group."""
    base = df.groupBy(*keys).agg(F.avg(latency).alias("avg"), F.max(latency).alias("max"))
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if approximate:
        arr = F.percentile_approx(latency, F.array(*[F.lit(p) for p in probs.values()]))
        return df.groupBy(*keys).agg(F.avg(latency).alias("avg"), F.max(latency).alias("max"), arr.alias("_q")).select(
            *keys, "avg", "max", *[F.col("_q")[i].alias(f"{n}_approx") for i, n in enumerate(probs)]
        )
    q = quantiles(df, latency, probs, keys=keys, rows_per_task=rows_per_task)
    return base.join(q, list(keys)) if keys else base.crossJoin(F.broadcast(q))


def message_counts(df: DataFrame, kind: str = "event_type") -> DataFrame:
    """Messages and active symbols per type: one row per (type, symbol) first, so no distinct set is held."""
    each = df.groupBy(kind, "symbol").agg(F.count("*").alias("_n"))
    return each.groupBy(kind).agg(F.sum("_n").alias("messages"), F.count("*").alias("active_symbols"))


def fill_performance(df: DataFrame) -> DataFrame:
    """One row over fill results (filled, partial, latency_us, slippage, impact)."""
    got = F.col("filled")
    return df.agg(
        F.count("*").alias("total_orders"), F.count_if(got).alias("filled_orders"),
        (F.count_if(got) / F.count("*")).alias("fill_rate"), F.avg("latency_us").alias("average_latency_us"),
        _zero(F.avg(F.when(got, F.col("slippage")))).alias("average_slippage"),
        _zero(F.avg(F.when(got, F.col("impact")))).alias("average_market_impact"),
        _zero(F.try_divide(F.count_if(got & F.col("partial")), F.count_if(got))).alias("partial_fill_rate"),
    )


def rejection_counts(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("filled") & F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def execution_quality(df: DataFrame, keys: Sequence[str] = ("symbol",), rows_per_task: int | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.sum("volume").alias("total_volume"), F.avg("volume").alias("avg_trade_size"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.avg("price").alias("price_avg"),
        F.stddev_pop("price").alias("price_std"), F.min("ts").alias("first_trade"), F.max("ts").alias("last_trade"),
    )
    mid = quantiles(df, "volume", {"median_trade_size": 0.5}, keys=keys, rows_per_task=rows_per_task)
    return out.join(mid, list(keys))


def run_comparison(runs: DataFrame) -> DataFrame:
    """One row per run and symbol from trade results (run_id, symbol, pnl, ts)."""
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(3.6e9)
    closed = F.col("pnl") != 0
    return runs.groupBy("run_id", "symbol").agg(
        F.sum("pnl").alias("total_pnl"), F.count("*").alias("total_trades"),
        _zero(F.try_divide(F.count_if(F.col("pnl") > 0), F.count_if(closed))).alias("win_rate"), hours.alias("duration_hours"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Over runs: sum, mean and population deviation of P&L, and the unweighted means of the rates."""
    return results.agg(
        F.count("*").alias("runs"), F.sum("total_pnl").alias("pnl_sum"), F.avg("total_pnl").alias("pnl_mean"),
        F.stddev_pop("total_pnl").alias("pnl_std"), F.avg("win_rate").alias("win_rate_mean"),
        F.avg("total_trades").alias("trades_mean"),
    )


def correlation_matrix(bars: DataFrame, value: str = "price", at: str = "bar", **shape) -> DataFrame:
    """Pairwise Pearson correlation on common bars, long form."""
    return pair_stats(centred_moments(bars, at=at, value=value, **{"last": False, **shape})).select("a", "b", "n", "corr")


def covariance_matrix(returns: DataFrame, value: str = "ret", at: str = "bar", last: int | None = None, **shape) -> DataFrame:
    """Sample covariance of all pairs a <= b, over each name's last ``last`` rows if given."""
    if last:
        w = Window.partitionBy("symbol").orderBy(F.desc(at))
        returns = returns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).drop("_r")
    return pair_stats(centred_moments(returns, at=at, value=value, diagonal=True, **{"last": False, **shape})).select("a", "b", "n", "covar", "mean_a", "mean_b")


def equity_monthly(df: DataFrame, ret: str = "ret", n: int = 21, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("bar",), **series) -> DataFrame:
    """Rolling sum and volatility of returns over a month of trading days."""
    from tickloom.operators.features import full

    def add(d, w):
        return d.withColumns({"return_sum": full(F.sum, ret, n, w), "return_vol": full(F.stddev_samp, ret, n, w)})

    return windowed(df, add, keys=keys, order=order, back=n, **series)


def spread_consistency(quotes: DataFrame, last: int = 100, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Spread mean and deviation per symbol over its last rows, and the mean of 1 / (1 + CV)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("seq"))
    spread = F.col("ask") - F.col("bid")
    each = (
        quotes.select("symbol", "ts", "seq", spread.alias("spread")).withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= last).groupBy("symbol")
        .agg(F.count("*").alias("n"), F.avg("spread").alias("spread_mean"), F.stddev_pop("spread").alias("spread_std"))
        .filter((F.col("n") >= least) & (F.col("spread_mean") > 0))
    )
    return each, each.agg(F.avg(1 / (1 + F.col("spread_std") / F.col("spread_mean"))).alias("consistency"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def common_times(df: DataFrame, at: str = "bar", name: str = "symbol") -> DataFrame:
    """Times at which every name has a row."""
    pairs = df.select(at, name).distinct()
    total = pairs.select(name).distinct().agg(F.count("*").alias("_all"))
    return pairs.groupBy(at).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).filter("_n = _all").select(at)


def first_last(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"),
    )


def equity_stats(df: DataFrame, value: str = "value", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **series) -> DataFrame:
    """Total return, annualised mean and volatility in percent, extremes, share of gains, skewness, kurtosis."""

    def add(d, w):
        return d.withColumn("_ret", ratio(F.col(value), F.lag(value).over(w)) - 1)

    r, at, n = F.col("_ret"), F.struct(*order), F.count("_ret")
    skew = F.when(n > 2, F.skewness(r) * F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)))
    kurt = F.when(n > 3, ((n + 1) * F.kurtosis(r) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))
    return windowed(df, add, keys=keys, order=order, back=1, **series).groupBy(*keys).agg(
        ((ratio(F.max_by(value, at), F.min_by(value, at)) - 1) * 100).alias("total_return_pct"),
        (F.avg(r) * 252 * 100).alias("annualized_return"), (F.stddev_pop(r) * F.sqrt(F.lit(252.0)) * 100).alias("volatility"),
        (F.max(r) * 100).alias("best"), (F.min(r) * 100).alias("worst"),
        (F.try_divide(F.count_if(r > 0), n) * 100).alias("positive_pct"), skew.alias("skewness"), kurt.alias("kurtosis"),
    )


