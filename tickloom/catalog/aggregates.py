"""Report aggregates, sorts, set operations."""

from pyspark.sql import functions as F

from tickloom.catalog.books import DAY_BARS, PAIRS, TYPE_BARS, day_bars, type_bars
from tickloom.catalog.registry import TICKS, TRADES, W, query, rounded
from tickloom.operators import aggregates as A
from tickloom.operators import risk as R
from tickloom.sources.standins import table, ticks, trades

_PNL = f"{TICKS}, tp AS (SELECT *, price - 50 AS pnl FROM ticks)"


def with_pnl(spark, sf_dir):
    """Ticks with a profit column: price above 50 wins."""
    return ticks(spark, sf_dir).withColumn("pnl", F.col("price") - 50)


_STATS = """count(*) AS total_trades, sum(volume) AS total_volume, avg(volume) AS average_trade_size, max(volume) AS largest_trade, min(volume) AS smallest_trade,
  count(*) FILTER (pnl > 0) / CAST(count(*) AS DOUBLE) * 100 AS win_rate, abs(sum(pnl) FILTER (pnl > 0) / nullif(sum(pnl) FILTER (pnl < 0), 0)) AS profit_factor,
  coalesce(avg(pnl) FILTER (pnl > 0), 0) AS average_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS average_loss, coalesce(max(pnl) FILTER (pnl > 0), 0) AS largest_win,
  coalesce(min(pnl) FILTER (pnl < 0), 0) AS largest_loss, count(*) / CAST(greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 1) AS DOUBLE) AS trades_per_day"""


@query(
    "trade_stats",
    f"""WITH {_PNL}, s AS (SELECT event_type, {_STATS} FROM tp GROUP BY event_type), h AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM tp GROUP BY ALL),
    m AS (SELECT event_type, arg_max(h, (n, -h)) AS most_active_hour, count(*) AS trading_hours_spread FROM h GROUP BY event_type) """
    + rounded("event_type total_trades most_active_hour trading_hours_spread",
    "total_volume average_trade_size largest_trade smallest_trade win_rate profit_factor average_win average_loss largest_win largest_loss trades_per_day", "(SELECT * FROM s JOIN m USING (event_type))", 5),
    digits=5,
)
def _(spark, sf_dir):
    return A.trade_stats(with_pnl(spark, sf_dir), keys=("event_type",))


@query(
    "trade_patterns",
    f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER ({W}) AS pos FROM ticks),
    v AS (SELECT symbol, corr(volume, pos) AS r, stddev_samp(volume) / avg(volume) AS cv FROM n GROUP BY symbol)
    SELECT symbol, round(r, 6) AS volume_corr, round(cv, 6) AS volume_cv, CASE WHEN r > 0.1 THEN 'increasing' WHEN r < -0.1 THEN 'decreasing' ELSE 'stable' END AS volume_trend FROM v""",
)
def _(spark, sf_dir):
    return A.volume_pattern(ticks(spark, sf_dir))


def _top(expr: str, k: int, label: str) -> str:
    return f"(SELECT '{label}' AS what, CAST(v AS VARCHAR) AS value, n, round(n / CAST(sum(n) OVER () AS DOUBLE) * 100, 6) AS share FROM (SELECT {expr} AS v, count(*) AS n FROM ticks GROUP BY 1) ORDER BY n DESC, v LIMIT {k})"


@query("trade_pattern_tops", f"WITH {TICKS} {_top('hour(ts)', 3, 'hour')} UNION ALL {_top('isodow(ts) - 1', 3, 'day')} UNION ALL {_top('symbol', 5, 'symbol')}")
def _(spark, sf_dir):
    """The top hours, days and symbols a trading report shows."""
    t = ticks(spark, sf_dir)
    tops = [A.top_counts(t, F.hour("ts"), 3, "hour"), A.top_counts(t, F.weekday("ts"), 3, "day"), A.top_counts(t, F.col("symbol"), 5, "symbol")]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


@query("hourly_counts", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return A.hourly_counts(ticks(spark, sf_dir))


@query("hour_of_day_counts", "SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return A.hourly_counts(ticks(spark, sf_dir), of_day=True)


@query("histogram", "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def _(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(
    "latency_percentiles",
    f"WITH {TICKS} " + rounded("event_type", "avg max p50 p95 p99", "(SELECT event_type, avg(price) AS avg, max(price) AS max, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.95) AS p95, quantile_cont(price, 0.99) AS p99 FROM ticks GROUP BY event_type)"),
)
def _(spark, sf_dir):
    """Prices stand in for milliseconds."""
    return A.latency_percentiles(ticks(spark, sf_dir), "price", keys=("event_type",))


@query("message_counts", f"WITH {TICKS} SELECT event_type, count(*) AS messages, count(DISTINCT symbol) AS active_symbols FROM ticks GROUP BY event_type")
def _(spark, sf_dir):
    return A.message_counts(ticks(spark, sf_dir))


def fills(spark, sf_dir):
    t = trades(spark, sf_dir)
    return t.select(
        (F.col("flag") != "R").alias("filled"), (F.col("volume") > 40).alias("partial"), (F.col("tax") * 1000).alias("latency_us"),
        F.col("discount").alias("slippage"), (F.col("discount") * F.col("volume")).alias("impact"),
        F.when(F.col("flag") == "R", F.when(F.col("volume") > 25, "size").otherwise("price")).alias("reason"),
    )


@query(
    "fill_performance",
    f"""WITH {TRADES} SELECT count(*) AS total_orders, count(*) FILTER (flag <> 'R') AS filled_orders, round(count(*) FILTER (flag <> 'R') / CAST(count(*) AS DOUBLE), 6) AS fill_rate,
    round(avg(tax * 1000), 6) AS average_latency_us, round(avg(discount) FILTER (flag <> 'R'), 6) AS average_slippage, round(avg(discount * volume) FILTER (flag <> 'R'), 6) AS average_market_impact,
    round(count(*) FILTER (flag <> 'R' AND volume > 40) / CAST(count(*) FILTER (flag <> 'R') AS DOUBLE), 6) AS partial_fill_rate FROM trades""",
)
def _(spark, sf_dir):
    return A.fill_performance(fills(spark, sf_dir))


@query("rejection_counts", f"WITH {TRADES} SELECT CASE WHEN volume > 25 THEN 'size' ELSE 'price' END AS reason, count(*) AS n FROM trades WHERE flag = 'R' GROUP BY 1")
def _(spark, sf_dir):
    return A.rejection_counts(fills(spark, sf_dir))


@query(
    "execution_quality",
    f"""WITH {TRADES} """ + rounded("symbol total_trades first_trade last_trade", "total_volume avg_trade_size median_trade_size price_min price_max price_avg price_std",
    """(SELECT symbol, count(*) AS total_trades, min(ts) AS first_trade, max(ts) AS last_trade, sum(volume) AS total_volume, avg(volume) AS avg_trade_size, median(volume) AS median_trade_size,
    min(price) AS price_min, max(price) AS price_max, avg(price) AS price_avg, stddev_pop(price) AS price_std FROM trades GROUP BY symbol)""", 4),
    digits=4,
)
def _(spark, sf_dir):
    return A.execution_quality(trades(spark, sf_dir))


_RUNS = f"""{_PNL}, rc AS (SELECT event_type AS run_id, symbol, sum(pnl) AS total_pnl, count(*) AS total_trades,
  coalesce(count(*) FILTER (pnl > 0) / CAST(nullif(count(*) FILTER (pnl <> 0), 0) AS DOUBLE), 0) AS win_rate, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(3600000000 AS DOUBLE) AS duration_hours FROM tp GROUP BY ALL)"""


def runs(spark, sf_dir):
    return A.run_comparison(with_pnl(spark, sf_dir).withColumnRenamed("event_type", "run_id"))


@query("run_comparison", f"WITH {_RUNS} " + rounded("run_id symbol total_trades", "total_pnl win_rate duration_hours", "rc", 5), digits=5)
def _(spark, sf_dir):
    return runs(spark, sf_dir)


@query("run_summary", f"WITH {_RUNS} " + rounded("runs", "pnl_sum pnl_mean pnl_std win_rate_mean trades_mean", "(SELECT count(*) AS runs, sum(total_pnl) AS pnl_sum, avg(total_pnl) AS pnl_mean, stddev_pop(total_pnl) AS pnl_std, avg(win_rate) AS win_rate_mean, avg(total_trades) AS trades_mean FROM rc)", 4), digits=4)
def _(spark, sf_dir):
    return A.run_summary(runs(spark, sf_dir))


@query(
    "correlation_matrix",
    f"""WITH {DAY_BARS}, pm AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.price, y.price) AS r FROM db x JOIN db y ON x.bar = y.bar AND x.symbol < y.symbol GROUP BY ALL)
    SELECT a, b, n, round(CASE WHEN NOT isnan(r) THEN r END, 5) AS corr FROM pm""",
    digits=5,
)
def _(spark, sf_dir):
    return A.correlation_matrix(day_bars(spark, sf_dir))


RETURNS = f"{DAY_BARS}, rt AS (SELECT symbol, bar, price / lag(price) OVER (PARTITION BY symbol ORDER BY bar) - 1 AS ret FROM db)"


def day_returns(spark, sf_dir):
    return R.with_returns(day_bars(spark, sf_dir), "price", order=("bar",)).select("symbol", "bar", "ret")


COV = f"""{RETURNS}, cv AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, covar_samp(x.ret, y.ret) AS covar, avg(x.ret) AS mean_a, avg(y.ret) AS mean_b
  FROM rt x JOIN rt y ON x.bar = y.bar AND x.symbol <= y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL)"""


@query("covariance_matrix", f"WITH {COV} " + rounded("a b n", "covar mean_a mean_b", "cv", 5), digits=5)
def _(spark, sf_dir):
    return A.covariance_matrix(day_returns(spark, sf_dir), last=252)


@query(
    "equity_monthly",
    f"""WITH {RETURNS} SELECT symbol, bar, round(CASE WHEN count(ret) OVER w >= 21 THEN sum(ret) OVER w END, 6) AS return_sum, round(CASE WHEN count(ret) OVER w >= 21 THEN stddev_samp(ret) OVER w END, 6) AS return_vol
    FROM rt WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf_dir):
    return A.equity_monthly(day_returns(spark, sf_dir)).drop("ret")


_SPREADS = f"""{TICKS}, s AS (SELECT symbol, count(*) AS n, avg(ask - bid) AS spread_mean, stddev_pop(ask - bid) AS spread_std FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS r FROM ticks)
  WHERE r <= 100 GROUP BY symbol HAVING count(*) >= 10)"""


@query("time_spread_stats", f"WITH {_SPREADS} SELECT symbol, n, round(spread_mean, 6) AS spread_mean, round(spread_std, 6) AS spread_std, round((SELECT avg(1 / (1 + spread_std / spread_mean)) FROM s), 6) AS consistency FROM s")
def _(spark, sf_dir):
    each, one = A.spread_consistency(ticks(spark, sf_dir))
    return each.crossJoin(F.broadcast(one))


@query("sort_limit_topk", f"WITH {TICKS} SELECT symbol, seq, ts, round(price, 6) AS price FROM ticks ORDER BY price DESC, seq LIMIT 10")
def _(spark, sf_dir):
    return A.top_k(ticks(spark, sf_dir), 10, F.desc("price"), F.col("seq")).select("symbol", "seq", "ts", "price")


@query("union_chunks", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type", digits=3)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [e.filter(F.col("user_id") % 2 == i).withColumn("chunk", F.lit(i)) for i in (0, 1)]
    return parts[0].unionByName(parts[1].drop("props"), allowMissingColumns=True).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


@query("intersect_index", f"WITH {TYPE_BARS} SELECT bar FROM kb GROUP BY bar HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM kb)")
def _(spark, sf_dir):
    return A.common_times(type_bars(spark, sf_dir))


@query("distinct_values", f"WITH {TICKS} SELECT DISTINCT symbol, side FROM ticks")
def _(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", "side").distinct()


@query("first_last", f"WITH {TICKS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, round(arg_min(price, (ts, seq)), 6) AS open, round(arg_max(price, (ts, seq)), 6) AS close FROM ticks GROUP BY symbol")
def _(spark, sf_dir):
    return A.first_last(ticks(spark, sf_dir))


@query(
    "equity_stats",
    f"""WITH {TICKS}, r AS (SELECT *, price / lag(price) OVER ({W}) - 1 AS ret FROM ticks) """
    + rounded("symbol", "total_return_pct annualized_return volatility best worst positive_pct skewness kurtosis",
    """(SELECT symbol, (arg_max(price, (ts, seq)) / arg_min(price, (ts, seq)) - 1) * 100 AS total_return_pct, avg(ret) * 25200 AS annualized_return, stddev_pop(ret) * sqrt(252) * 100 AS volatility,
    max(ret) * 100 AS best, min(ret) * 100 AS worst, count(*) FILTER (ret > 0) / CAST(count(ret) AS DOUBLE) * 100 AS positive_pct, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis FROM r GROUP BY symbol)""", 4),
    digits=4,
)
def _(spark, sf_dir):
    return A.equity_stats(ticks(spark, sf_dir), "price")


