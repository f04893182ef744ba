"""Return statistics, value at risk, limits and position sizing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.operators.pnl import signed_volume
from tickloom.plans.pairs import centred_moments, pair_stats
from tickloom.plans.series import broadcast_if_small, numbered, placed, quantiles, running, unplaced, windowed
from tickloom.plans.shuffling import mixed

TRADING_DAYS = 252
# Normal quantiles for the usual confidence levels, and those of the simple position figure.
Z_SCORES = {0.90: 1.2815515655446004, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
POSITION_Z = {0.95: 1.96, 0.99: 2.58}
# Limits beyond the configured ones, score per level, recommended action.
MAX_VOLATILITY, MAX_SPREAD = 0.5, 0.01
LEVEL_SCORES = {"critical": 40.0, "high": 25.0, "medium": 15.0, "low": 5.0}


def with_returns(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    return windowed(
        df, lambda d, w: d.withColumn("ret", ratio(value, F.lag(value).over(w)) - 1), keys=keys, order=order, back=1, **how
    )


def drawdown(
    df: DataFrame, value: str = "value", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), ts: str = "ts", **how
) -> DataFrame:
    """Deepest fall per key in money and as a fraction of the peak (null for a peak <= 0), with peak and trough time."""
    v = F.col(value)
    top = running(placed(df, keys=keys, order=order, **how), {"_peak": ("max", v)}, keys=keys, order=order, **how)
    fall = F.col("_peak") - v
    share = F.when(F.col("_peak") > 0, fall / F.col("_peak"))
    marked = top.withColumns({"_fall": fall, "_share": share, "_us": F.unix_micros(ts)})
    at_peak = running(marked, {"_peak_us": ("last", F.when(F.col("_fall") == 0, F.col("_us")))}, keys=keys, order=order, **how)
    deepest = F.struct("_share", (-F.col("_us")).alias("t"))
    return at_peak.groupBy(*keys).agg(
        F.max("_fall").alias("max_drawdown_money"), F.max("_share").alias("max_drawdown"),
        F.timestamp_micros(F.max_by("_peak_us", deepest)).alias("peak_ts"),
        F.timestamp_micros(F.max_by("_us", deepest)).alias("trough_ts"),
    )


def pnl_drawdown(df: DataFrame, pnl: str = "ret", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """Lowest value of the running sum minus its running maximum (zero or negative)."""
    known = placed(df.filter(F.col(pnl).isNotNull()), keys=keys, order=order, **how)
    x = running(known, {"_sum": ("sum", F.col(pnl))}, keys=keys, order=order, **how)
    x = running(x, {"_max": ("max", F.col("_sum"))}, keys=keys, order=order, **how)
    return x.groupBy(*keys).agg(F.min(F.col("_sum") - F.col("_max")).alias("pnl_drawdown"))


def _zero_if_flat(value: Column, spread: Column) -> Column:
    return F.when(spread.isNull() | (spread == 0), F.lit(0.0)).otherwise(value)


def sharpe(returns: DataFrame, ret: str = "ret", risk_free: float = 0.0, population: bool = False, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    sd = (F.stddev_pop if population else F.stddev_samp)(ret)
    mean = F.avg(ret) - F.lit(risk_free / TRADING_DAYS)
    return returns.groupBy(*keys).agg(
        _zero_if_flat(F.try_divide(mean, sd) * F.lit(math.sqrt(TRADING_DAYS)), sd).alias("sharpe")
    )


def sortino(returns: DataFrame, ret: str = "ret", risk_free: float = 0.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    x = F.col(ret) - F.lit(risk_free / TRADING_DAYS)
    sd = F.stddev_samp(F.when(x < 0, x))
    return returns.groupBy(*keys).agg(
        _zero_if_flat(F.try_divide(F.avg(x), sd) * F.lit(math.sqrt(TRADING_DAYS)), sd).alias("sortino")
    )


def calmar(returns: DataFrame, ret: str = "ret", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """Annual mean over the depth of the summed returns' drawdown."""
    deep = pnl_drawdown(returns, ret, keys, order, **how)
    mean = returns.groupBy(*keys).agg((F.avg(ret) * TRADING_DAYS).alias("_annual"))
    value = F.coalesce(F.try_divide(F.col("_annual"), F.abs("pnl_drawdown")), F.lit(0.0))
    return mean.join(deep, list(keys)).withColumn("calmar", value).drop("_annual", "pnl_drawdown")


def information_ratio(returns: DataFrame, benchmark: DataFrame, at: str = "bar", ret: str = "ret", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean over population deviation of the return above the benchmark (columns ``at``, ``bench``)."""
    x = F.col(ret) - F.col("bench")
    sd = F.stddev_pop(x)
    return returns.join(broadcast_if_small(benchmark), at).groupBy(*keys).agg(
        F.count(x).alias("n"), _zero_if_flat(F.try_divide(F.avg(x), sd) * F.lit(math.sqrt(TRADING_DAYS)), sd).alias("information_ratio")
    )


def tail_ratio(returns: DataFrame, ret: str = "ret", level: float = 0.95, keys: Sequence[str] = ("symbol",), rows_per_task: int | None = None) -> DataFrame:
    q = quantiles(returns, ret, {"_hi": level, "_lo": 1 - level}, keys=keys, rows_per_task=rows_per_task)
    return q.select(*keys, F.try_divide(F.abs("_hi"), F.abs("_lo")).alias("tail_ratio"))


def win_rate(closes: DataFrame, keys: Sequence[str] = ("symbol",), pnl: str = "pnl") -> DataFrame:
    """Share of winning closes among those that made or lost something."""
    p = F.col(pnl)
    return closes.groupBy(*keys).agg(
        F.count_if(p != 0).alias("closes"), F.coalesce(F.try_divide(F.count_if(p > 0), F.count_if(p != 0)), F.lit(0.0)).alias("win_rate")
    )


def rolling_sharpe(returns: DataFrame, ret: str = "ret", n: int = TRADING_DAYS, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """Rolling mean over deviation (0 when flat) and cumulative return in percent."""
    from tickloom.operators.features import full

    def add(d, w):
        mean, sd = full(F.avg, ret, n, w), full(F.stddev_samp, ret, n, w)
        value = F.when(mean.isNotNull(), _zero_if_flat(F.try_divide(mean, sd) * F.lit(math.sqrt(TRADING_DAYS)), sd))
        return d.withColumn("rolling_sharpe", value)

    out = windowed(placed(returns, keys=keys, order=order, **how), add, keys=keys, order=order, back=n, **how)
    grown = running(out, {"_log": ("sum", F.log1p(F.col(ret)))}, keys=keys, order=order, **how)
    return unplaced(grown).withColumn("cumulative_return_pct", (F.exp(F.coalesce("_log", F.lit(0.0))) - 1) * 100).drop("_log")


def portfolio_variance(returns: DataFrame, weights: DataFrame, at: str = "bar", ret: str = "ret", **shape) -> DataFrame:
    """w' C w from the long covariance table: one row."""
    cov = pair_stats(centred_moments(returns, at=at, value=ret, diagonal=True, **shape)).select("a", "b", "covar")
    w = weights.select(F.col("symbol").alias("_s"), "weight")
    wa = broadcast_if_small(w.withColumnsRenamed({"_s": "a", "weight": "wa"}))
    wb = broadcast_if_small(w.withColumnsRenamed({"_s": "b", "weight": "wb"}))
    twice = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.lit(2.0))
    return cov.join(wa, "a").join(wb, "b").agg(F.sum(twice * F.col("wa") * F.col("wb") * F.col("covar")).alias("variance"))


def var_es_parametric(returns: DataFrame, weights: DataFrame, confidence: float = 0.95, **how) -> DataFrame:
    z = Z_SCORES[confidence]
    sd = F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return portfolio_variance(returns, weights, **how).select(
        sd.alias("sigma"), (sd * F.lit(z)).alias("var"), (sd * F.lit(density / (1 - confidence))).alias("expected_shortfall")
    )


def var_historical(returns: DataFrame, positions: DataFrame, confidence: float = 0.95, least: int = 20, ret: str = "ret", rows_per_task: int | None = None) -> DataFrame:
    """|position value * return quantile| per symbol with more than ``least`` prices, else 0."""
    q = quantiles(returns, ret, {"_q": 1 - confidence}, rows_per_task=rows_per_task)
    n = returns.groupBy("symbol").agg(F.count("*").alias("_n"))
    enough = F.when(F.col("_n") > least, F.abs(F.col("position_value") * F.col("_q"))).otherwise(F.lit(0.0))
    return positions.join(n, "symbol", "left").join(q, "symbol", "left").select("symbol", "position_value", F.coalesce(enough, F.lit(0.0)).alias("var"))


def var_bootstrap(
    portfolio: DataFrame, draws: int = 10_000, horizon: int = 10, confidence: float = 0.95, seed: int = 7, at: str = "bar", pnl: str = "pnl",
    rows_per_task: int | None = None,
) -> DataFrame:
    """VaR and expected shortfall from sums of ``horizon`` days drawn with replacement.

    ``portfolio`` is one row per day.  The day of a draw comes from a hash of its
    number in whole-number arithmetic, so a recomputed task, and any engine, draws
    the same days.
    """
    spark = portfolio.sparkSession
    days = numbered(portfolio.select(at, pnl), "_day", keys=(), order=(at,), rows_per_task=rows_per_task).withColumn("_day", F.col("_day") - 1)
    size = days.agg(F.count("*").alias("_days"))
    picks = (
        spark.range(draws * horizon)
        .select(F.floor(F.col("id") / horizon).alias("draw"), mixed(F.col("id"), seed).alias("_hash"))
        .crossJoin(F.broadcast(size))
        .withColumn("_day", F.pmod("_hash", "_days"))
    )
    sums = picks.join(broadcast_if_small(days), "_day").groupBy("draw").agg(F.sum(pnl).alias("total"))
    cut = quantiles(sums, "total", {"_cut": 1 - confidence}, keys=())
    return sums.crossJoin(F.broadcast(cut)).agg(
        F.count("*").alias("draws"), (-F.max("_cut")).alias("var"),
        F.coalesce(-F.avg(F.when(F.col("total") <= F.col("_cut"), F.col("total"))), F.lit(0.0)).alias("expected_shortfall"),
    )


def portfolio_beta(returns: DataFrame, market: DataFrame, positions: DataFrame, at: str = "bar", ret: str = "ret") -> DataFrame:
    """Weights times each symbol's covariance with the market over the market's variance (columns ``at``, ``market``)."""
    betas = returns.join(broadcast_if_small(market), at).groupBy("symbol").agg(
        ratio(F.covar_samp(ret, "market"), F.var_samp(F.when(F.col(ret).isNotNull(), F.col("market")))).alias("beta")
    )
    both = positions.join(betas, "symbol")
    total = positions.agg(F.sum(F.abs("weight")).alias("_total"))
    return both.crossJoin(F.broadcast(total)).agg(
        F.sum(ratio(F.abs("weight"), "_total") * F.col("beta")).alias("portfolio_beta")
    )


def stress_test(positions: DataFrame, scenarios: DataFrame, on: str = "symbol") -> DataFrame:
    """Profit per scenario; positions are summed per asset first, and a scenario nobody is exposed to gives 0."""
    held = positions.groupBy(on).agg(F.sum("market_value").alias("_value"))
    return broadcast_if_small(scenarios).join(held, on, "left").groupBy("scenario").agg(
        F.sum(F.coalesce(F.col("_value") * F.col("shock"), F.lit(0.0))).alias("pnl")
    )


def position_sizing(
    signals: DataFrame, positions: DataFrame, capital: float, max_share: float = 0.1, max_value: float = 1e6
) -> DataFrame:
    """Signed whole size from strength, volatility (factor 0.1..2) and portfolio heat (one row); null at a price of zero."""
    heat = positions.agg((F.sum(F.abs("market_value")) / F.lit(capital)).alias("_heat"))
    vol = F.least(F.lit(2.0), F.greatest(F.lit(0.1), 1 / F.greatest(F.lit(0.01), F.col("volatility") * 10)))
    cool = F.greatest(F.lit(0.1), 1 - F.coalesce("_heat", F.lit(0.0)))
    value = F.lit(capital) * F.lit(max_share) * F.abs("strength") * vol * cool
    size = F.least(F.floor(ratio(value, "price")), F.floor(ratio(F.lit(max_value), "price")))
    return signals.crossJoin(F.broadcast(heat)).withColumn("size", F.when(F.col("strength") < 0, -size).otherwise(size)).drop("_heat")


def risk_score(share: Column, drawdown_share: Column, volatility: Column) -> tuple[Column, Column]:
    """Score 0-100 and its level."""
    score = F.least(F.lit(100.0), share * 100 + drawdown_share * 200 + volatility * 50)
    level = F.when(score < 20, "low").when(score < 50, "medium").when(score < 80, "high").otherwise("critical")
    return score, level


def position_risk(size: Column, price: Column, volatility: Column, confidence: float = 0.95) -> dict[str, Column]:
    value = F.abs(size * price)
    return {
        "position_value": value,
        "daily_var": value * volatility / F.lit(math.sqrt(TRADING_DAYS)) * F.lit(POSITION_Z[confidence]),
        "risk_score": F.least(F.lit(100.0), volatility * 100),
    }


def _violation(kind: str, level: str, current: Column, limit: Column, action: str) -> Column:
    """A violation struct, or null when the value is within the limit."""
    return F.when(
        current > limit,
        F.struct(
            F.lit(kind).alias("kind"), F.lit(level).alias("level"), current.cast("double").alias("current"),
            limit.cast("double").alias("limit"), (current - limit).cast("double").alias("excess"), F.lit(action).alias("action"),
        ),
    )


def check_orders(
    requests: DataFrame, positions: DataFrame, own_limits: DataFrame, market: DataFrame, *,
    max_order: float, max_position_value: float, max_exposure: float, max_loss: float,
) -> DataFrame:
    """Orders (symbol, side, volume, price) against every limit: violations, score and approval.

    positions: symbol, qty, avg_price, pnl; own_limits: symbol, own_limit (size);
    market: symbol, volatility, spread_share.  Totals are one row.
    """
    totals = positions.agg(
        F.coalesce(F.sum(F.abs(F.col("qty") * F.col("avg_price"))), F.lit(0.0)).alias("_exposure"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("_pnl"),
    )
    facts = (
        requests.join(broadcast_if_small(positions.select("symbol", "qty")), "symbol", "left")
        .join(broadcast_if_small(own_limits.select("symbol", "own_limit")), "symbol", "left")
        .join(broadcast_if_small(market.select("symbol", "volatility", "spread_share")), "symbol", "left")
        .crossJoin(F.broadcast(totals))
    )
    value = F.coalesce(F.col("price"), F.lit(0.0)) * F.col("volume")
    signed = signed_volume()
    size = F.abs(F.coalesce("qty", F.lit(0.0)) + signed)
    own = _violation("position_limit", "high", size, F.col("own_limit"), "Order blocked")
    everyone = _violation("position_limit", "high", size * F.coalesce("price", F.lit(0.0)), F.lit(max_position_value), "Order blocked")
    rules = F.array(
        _violation("order_size_limit", "high", value, F.lit(max_order), "Order blocked"),
        F.coalesce(own, everyone),
        _violation("exposure_limit", "high", F.col("_exposure") + value, F.lit(max_exposure), "Order blocked"),
        _violation("loss_limit", "critical", -F.col("_pnl"), F.lit(max_loss), "Trading halted"),
        _violation("volatility_limit", "medium", F.col("volatility"), F.lit(MAX_VOLATILITY), "Order flagged"),
        _violation("liquidity_limit", "medium", F.col("spread_share"), F.lit(MAX_SPREAD), "Order flagged"),
    )
    points = F.create_map(*[F.lit(x) for kv in LEVEL_SCORES.items() for x in kv])
    found = F.col("violations")
    score = F.aggregate(found, F.lit(0.0), lambda acc, v: acc + points[v["level"]])
    return facts.withColumn("violations", F.array_compact(rules)).select(
        *requests.columns, "violations", F.least(F.lit(100.0), score).alias("risk_score"), (F.size(found) == 0).alias("approved")
    )


def violation_rows(checked: DataFrame, ids: Sequence[str]) -> DataFrame:
    return checked.select(*ids, F.explode("violations").alias("v")).select(*ids, "v.*")


def limit_scan(positions: DataFrame, own_limits: DataFrame, max_exposure: float) -> DataFrame:
    """All positions against their own value limit, and the total against the exposure limit."""
    value = F.abs(F.col("qty") * F.col("avg_price"))
    each = positions.join(broadcast_if_small(own_limits), "symbol").withColumn(
        "v", _violation("position_limit", "high", value, F.col("own_limit"), "")
    ).filter(F.col("v").isNotNull()).select("symbol", "v.kind", "v.level", "v.current", "v.limit", "v.excess")
    total = positions.agg(F.sum(value).alias("_t")).withColumn(
        "v", _violation("exposure_limit", "high", F.col("_t"), F.lit(max_exposure), "")
    ).filter(F.col("v").isNotNull()).select(F.lit(None).cast("string").alias("symbol"), "v.kind", "v.level", "v.current", "v.limit", "v.excess")
    return each.unionByName(total)


def maker_performance(own: DataFrame, submitted: DataFrame, max_inventory: float, last: int = 20) -> DataFrame:
    """P&L per trade, fill rate, adverse share of the last fills, inventory score per symbol.

    own: symbol, ts, seq, pnl, adverse, position; submitted: symbol, orders.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("seq"))
    recent = own.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).groupBy("symbol").agg(
        F.avg(F.col("adverse").cast("double")).alias("adverse_rate"), F.count("*").alias("_recent")
    )
    main = own.groupBy("symbol").agg(
        F.sum("pnl").alias("total_pnl"), F.count("*").alias("fills"), F.max_by("position", F.struct("ts", "seq")).alias("position")
    )
    out = main.join(recent, "symbol").join(submitted, "symbol", "left")
    return out.select(
        "symbol", "total_pnl", F.coalesce(F.try_divide("total_pnl", "fills"), F.lit(0.0)).alias("pnl_per_trade"),
        F.coalesce(F.try_divide(F.col("fills"), F.col("orders")), F.lit(0.0)).alias("fill_rate"),
        F.when(F.col("_recent") > 10, F.col("adverse_rate")).otherwise(F.lit(0.0)).alias("adverse_selection_rate"),
        (F.abs("position") / F.lit(max_inventory)).alias("risk_score"),
    )


def transaction_costs(orders: DataFrame, base_probability: float = 0.95, slippage_factor: float = 0.0001) -> DataFrame:
    """Expected cost columns for orders that carry their quote.

    Needs: side, order_type, volume, price (limit), bid, ask, bid_volume, ask_volume.
    """
    c = F.col
    buy = c("side").isin("bid", "buy")
    mid, spread = (c("bid") + c("ask")) / 2, c("ask") - c("bid")
    depth = c("bid_volume") + c("ask_volume")
    usual = F.greatest(depth / 10, F.lit(1000.0))
    impact = F.when(buy, 1).otherwise(-1) * ratio(spread, mid) * F.sqrt(c("volume") / usual) * mid
    market = c("order_type") == "market"
    other = F.when(buy, c("ask_volume")).otherwise(c("bid_volume"))
    filled = F.when(market, F.when(buy, c("ask")).otherwise(c("bid")) + impact).otherwise(
        F.when(buy & (c("price") >= c("ask")), F.least("price", "ask"))
        .when(~buy & (c("price") <= c("bid")), F.greatest("price", "bid")).otherwise(c("price"))
    )
    worse = F.greatest(F.lit(0.0), F.when(buy, filled - c("price")).otherwise(c("price") - filled))
    slippage = F.when(market, F.abs(filled - mid)).otherwise(worse) + F.lit(slippage_factor) * mid * F.sqrt(c("volume") / 1000)
    crosses = F.when(buy, c("price") >= c("ask")).otherwise(c("price") <= c("bid"))
    odds = F.when(
        market,
        F.when(other > 0, F.lit(base_probability) * (1 - F.lit(0.3) * F.least(F.lit(1.0), F.try_divide(c("volume"), other)))).otherwise(F.lit(0.1)),
    ).otherwise(F.lit(base_probability) * F.when(crosses, 0.9).otherwise(0.3))
    return orders.withColumns(
        {
            "market_impact": impact, "execution_price": filled, "slippage": slippage, "fill_probability": odds,
            "volatility_score": F.least(F.lit(1.0), F.coalesce(ratio(spread, mid) / 0.005, F.lit(0.5))),
            "liquidity_score": F.least(F.lit(1.0), depth / 10000),
        }
    )
