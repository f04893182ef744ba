"""Windows and time-series features."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import TICKS, W, query, rounded
from tickloom.operators import bars as B
from tickloom.operators import cleaning, features as X
from tickloom.sources.standins import ticks

BASE = f"""{TICKS}, d AS (SELECT *, lag(price) OVER ({W}) AS prev, price * volume AS notional, (bid + ask) / 2 AS mid, ask - bid AS spread,
  (bid_volume - ask_volume) / (bid_volume + ask_volume) AS imbalance, CASE side WHEN 'bid' THEN 1 WHEN 'ask' THEN -1 ELSE 0 END AS sgn,
  CASE WHEN price >= (bid + ask) / 2 THEN 1 ELSE -1 END AS dir FROM ticks),
b AS (SELECT *, price - prev AS diff, price / prev - 1 AS ret, coalesce(greatest(price - prev, 0), 0) AS gain, coalesce(greatest(prev - price, 0), 0) AS loss,
  coalesce(CAST(price > prev AS DOUBLE), 0) AS up, sgn * volume AS flow, CASE WHEN sgn > 0 THEN volume ELSE 0 END AS buy,
  CASE WHEN sgn < 0 THEN volume ELSE 0 END AS sell, dir * volume AS dv, (price / prev - 1) * (price / prev - 1) AS ret2 FROM d)"""


def f(n: int, end: int = 0) -> str:
    last = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"({W} ROWS BETWEEN {n - 1 + end} PRECEDING AND {last})"


def roll(fn: str, col: str, n: int, end: int = 0) -> str:
    """Rolling aggregate, null until n values are there."""
    return f"CASE WHEN count({col}) OVER {f(n, end)} >= {n} THEN {fn}({col}) OVER {f(n, end)} END"


def lagged(col: str, n: int) -> str:
    return f"lag({col}, {n}) OVER ({W})"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def safe(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL WHEN abs({b}) < 1e-10 THEN 0 ELSE ({a}) / ({b}) END"


def sql(cols: dict[str, str], base: str = "b", tail: str = "") -> str:
    inner = f"(SELECT symbol, seq, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {base}{tail})"
    return f"WITH {BASE} " + rounded("symbol seq", " ".join(cols), inner)


def feature_query(name: str, cols: dict[str, str]):
    """A query computing registered features, with SQL per column."""
    query(name, sql(cols))(
        lambda spark, sf_dir: X.compute(ticks(spark, sf_dir), list(cols)).select("symbol", "seq", *cols)
    )


feature_query("price_change", {"price_change": "diff", "price_change_pct": "ret"})
feature_query("inter_arrival_ms", {"inter_arrival_ms": f"(epoch_us(ts) - lag(epoch_us(ts)) OVER ({W})) / CAST(1000 AS DOUBLE)"})
feature_query(
    "sma",
    {f"sma_{n}": roll("avg", "price", n) for n in (5, 10, 20, 50, 100)}
    | {f"price_minus_sma_{n}": f"price - {roll('avg', 'price', n)}" for n in (5, 20)},
)
feature_query("momentum_pct", {f"momentum_{n}": f"price / {lagged('price', n)} - 1" for n in (5, 10, 20)})
feature_query("trend_5", {"trend_5": f"coalesce(sign(price - {lagged('price', 5)}), 0)"})
feature_query(
    "rolling_volatility",
    {f"rolling_std_ret_{n}": roll("stddev_samp", "ret", n) for n in (5, 10, 20, 50, 100)}
    | {"volatility_20": f"sqrt(252) * {roll('stddev_samp', 'ret', 20)}"},
)
feature_query("realized_vol", {f"realized_vol_{n}": f"sqrt({roll('sum', 'ret2', n)})" for n in (5, 10, 20)})
feature_query(
    "high_low_vol",
    {
        "high_20": roll("max", "price", 20), "low_20": roll("min", "price", 20),
        "high_low_vol": safe(f"({roll('max', 'price', 20)}) - ({roll('min', 'price', 20)})", "price"),
    },
)
feature_query(
    "signed_flow",
    {"signed_volume": "flow"}
    | {f"signed_flow_{n}": roll("sum", "flow", n) for n in (10, 20, 50)}
    | {f"flow_ratio_{n}": safe(roll("sum", "flow", n), roll("sum", "volume", n)) for n in (10, 20)},
)
feature_query("buy_sell_ratio", {f"buy_sell_ratio_{n}": safe(roll("sum", "buy", n), roll("sum", "sell", n)) for n in (10, 20)})
feature_query(
    "return_family",
    {f"returns_{n}": f"price / {lagged('price', n)} - 1" for n in (5, 20)}
    | {f"log_returns_{n}": f"ln(price / {lagged('price', n)})" for n in (5, 20)}
    | {f"price_sma_ratio_{n}": f"price / ({roll('avg', 'price', n)}) - 1" for n in (5, 20)}
    | {f"price_std_{n}": roll("stddev_samp", "price", n) for n in (5, 20)}
    | {"acceleration_5": f"price / {lagged('price', 5)} - {lagged('price', 1)} / {lagged('price', 6)}"},
)
feature_query(
    "volume_family",
    {f"volume_ma_{n}": roll("avg", "volume", n) for n in (10, 20)}
    | {f"volume_ratio_{n}": div("volume", roll("avg", "volume", n)) for n in (10, 20)}
    | {f"vwap_{n}": div(roll("sum", "notional", n), roll("sum", "volume", n)) for n in (10, 20)}
    | {f"price_vwap_ratio_{n}": div("price", div(roll("sum", "notional", n), roll("sum", "volume", n))) + " - 1" for n in (10, 20)},
)
feature_query(
    "quote_family",
    {"spread": "spread", "spread_pct": "spread / nullif(mid, 0)", "mid_price": "mid", "price_vs_mid": "price / nullif(mid, 0) - 1"}
    | {f"spread_ma_{n}": roll("avg", "spread", n) for n in (5, 20)}
    | {f"spread_std_{n}": roll("stddev_samp", "spread", n) for n in (5, 20)}
    | {f"bid_ask_imbalance_{n}": roll("avg", "imbalance", n) for n in (5, 20)},
)
_M, _S = roll("avg", "price", 20), roll("stddev_samp", "price", 20)

@query(
    "bollinger",
    sql(
        {"bb_upper": f"({_M}) + 2 * ({_S})", "bb_lower": f"({_M}) - 2 * ({_S})"}
        | {f"bb_position_{n}": div(f"price - ({_M}) + {k} * ({_S})", f"2 * {k} * ({_S})") for n, k in (("1", 1.0), ("2", 2.0), ("2h", 2.5))}
    ),
)
def _(spark, sf_dir):
    names = {"bb_upper_20_2": "bb_upper", "bb_lower_20_2": "bb_lower", "bb_position_20_1": "bb_position_1",
             "bb_position_20_2": "bb_position_2", "bb_position_20_25": "bb_position_2h"}
    out = X.compute(ticks(spark, sf_dir), list(names))
    return out.select("symbol", "seq", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


def _rsi(n: int) -> str:
    g, l = roll("avg", "gain", n), roll("avg", "loss", n)
    return f"CASE WHEN ({l}) = 0 THEN CASE WHEN ({g}) > 0 THEN 100 END ELSE 100 - 100 / (1 + ({g}) / ({l})) END"


feature_query("rsi", {f"rsi_{n}": _rsi(n) for n in (5, 14, 21)})
feature_query("volume_zscore", {f"volume_zscore_{n}": div(f"volume - ({roll('avg', 'volume', n)})", roll("stddev_samp", "volume", n)) for n in (5, 20)})
feature_query("trade_direction", {"trade_direction": "dir"})
feature_query(
    "order_flow",
    {f"order_flow_{n}": roll("sum", "dv", n) for n in (10, 50)}
    | {"direction_sum_10": roll("sum", "dir", 10), "trade_intensity_10": roll("sum", "volume", 10)},
)
feature_query("tick_direction", {"tick_direction": "sign(diff)", "uptick_ratio_20": roll("avg", "up", 20)})
_J = f"coalesce(abs(ret) > 3 * ({roll('stddev_samp', 'ret', 50)}), FALSE)"
feature_query("jump", {"jump_indicator": f"CAST({_J} AS INT)", "jump_size": f"CASE WHEN {_J} THEN abs(ret) ELSE 0 END"})
feature_query("spread_volatility", {"spread_volatility": roll("stddev_samp", "spread", 20)})
feature_query("forward_impact", {f"price_impact_{h}": f"lead(price, {h}) OVER ({W}) / price - 1" for h in (1, 2, 3, 5, 10)})
feature_query("annualised_vol", {"annualised_vol": f"sqrt(252 * 390) * {roll('stddev_pop', 'ret', 19)}"})
feature_query("last_n_vwap", {"last_100_vwap": f"sum(notional) OVER {f(100)} / nullif(sum(volume) OVER {f(100)}, 0)"})
feature_query(
    "rolling_moments",
    {f"skewness_{n}": roll("skewness", "ret", n) for n in (20, 50)} | {f"kurtosis_{n}": roll("kurtosis", "ret", n) for n in (20, 50)},
)


@query(
    "autocorr",
    f"WITH {BASE}, l AS (SELECT *, " + ", ".join(f"{lagged('ret', k)} AS r{k}" for k in (1, 2, 5)) + " FROM b) "
    + rounded(
        "symbol seq", "autocorr_1 autocorr_2 autocorr_5",
        "(SELECT symbol, seq, " + ", ".join(
            f"CASE WHEN count(ret) OVER {f(50)} >= 50 THEN corr(ret, r{k}) OVER {f(50 - k)} END AS autocorr_{k}" for k in (1, 2, 5)
        ) + " FROM l)",
    ),
)
def _(spark, sf_dir):
    names = [f"autocorr_{k}" for k in (1, 2, 5)]
    return X.compute(ticks(spark, sf_dir), names).select("symbol", "seq", *names)


@query("cumulative_volume", sql({"cumulative_volume": f"sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING)"}))
def _(spark, sf_dir):
    return X.cumulative_volume(ticks(spark, sf_dir)).select("symbol", "seq", "cumulative_volume")


@query("running_vwap", sql({"running_vwap": div(f"sum(notional) OVER ({W} ROWS UNBOUNDED PRECEDING)", f"sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING)")}))
def _(spark, sf_dir):
    return X.running_vwap(ticks(spark, sf_dir)).select("symbol", "seq", "running_vwap")


# Exponential averages by their definition: a weighted sum over all earlier rows of the series.
_NUM = f"{TICKS}, n AS (SELECT symbol, seq, price, row_number() OVER ({W}) AS i FROM ticks)"


def _ema_alpha(a: float) -> str:
    return f"sum(p.price * pow({1 - a}, t.i - p.i) * CASE WHEN p.i = 1 THEN 1 ELSE {a} END)"


def _ema_span(n: int, x: str = "p.price") -> str:
    q = 1 - 2 / (n + 1)
    return f"sum({x} * pow({q!r}, t.i - p.i)) / sum(pow({q!r}, t.i - p.i))"


@query(
    "ema_alpha",
    f"WITH {_NUM} " + rounded(
        "symbol seq", "ema_1 ema_3 ema_5 gap_3",
        f"""(SELECT t.symbol, t.seq, {_ema_alpha(0.1)} AS ema_1, {_ema_alpha(0.3)} AS ema_3, {_ema_alpha(0.5)} AS ema_5,
        any_value(t.price) - {_ema_alpha(0.3)} AS gap_3 FROM n t JOIN n p ON p.symbol = t.symbol AND p.i <= t.i GROUP BY t.symbol, t.seq)""",
    ),
)
def _(spark, sf_dir):
    names = {"ema_alpha_10": "ema_1", "ema_alpha_30": "ema_3", "ema_alpha_50": "ema_5", "price_minus_ema_30": "gap_3"}
    out = X.compute(ticks(spark, sf_dir), list(names))
    return out.select("symbol", "seq", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query(
    "ema_span",
    f"WITH {_NUM} " + rounded(
        "symbol seq", "ema_12 ema_50 price_ema_ratio_12",
        f"""(SELECT t.symbol, t.seq, {_ema_span(12)} AS ema_12, {_ema_span(50)} AS ema_50,
        any_value(t.price) / ({_ema_span(12)}) - 1 AS price_ema_ratio_12 FROM n t JOIN n p ON p.symbol = t.symbol AND p.i <= t.i GROUP BY t.symbol, t.seq)""",
    ),
)
def _(spark, sf_dir):
    names = ["ema_12", "ema_50", "price_ema_ratio_12"]
    return X.compute(ticks(spark, sf_dir), names).select("symbol", "seq", *names)


@query(
    "macd_hist",
    f"""WITH {_NUM}, m AS (SELECT t.symbol, t.seq, t.i, {_ema_span(12)} - {_ema_span(26)} AS line
    FROM n t JOIN n p ON p.symbol = t.symbol AND p.i <= t.i GROUP BY t.symbol, t.seq, t.i) """
    + rounded("symbol seq", "macd_hist", f"""(SELECT t.symbol, t.seq, any_value(t.line) - {_ema_span(9, 'p.line')} AS macd_hist
    FROM m t JOIN m p ON p.symbol = t.symbol AND p.i <= t.i GROUP BY t.symbol, t.seq)"""),
)
def _(spark, sf_dir):
    return X.macd_hist(ticks(spark, sf_dir)).select("symbol", "seq", F.col("macd_hist_12_26_9").alias("macd_hist"))


_LAGS = {f"price_lag_{k}": lagged("price", k) for k in (1, 2, 3, 5, 10)}
for _n in (5, 10, 20):
    for _l, _f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
        _LAGS[f"price_{_l}_{_n}"] = roll(_f, "price", _n, 1)
_LAGS |= {
    "volume_lag_1": lagged("volume", 1), "volume_mean_10": roll("avg", "volume", 10, 1), "spread_lag_1": lagged("spread", 1),
    "order_flow_lag_1": roll("sum", "flow", 10, 1), "target": f"lead(price, 5) OVER ({W})",
}


@query(
    "lag_features",
    f"WITH {BASE} " + rounded(
        "symbol seq hour minute day_of_week", " ".join(_LAGS),
        f"(SELECT symbol, seq, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS day_of_week, {', '.join(f'{e} AS {n}' for n, e in _LAGS.items())} FROM b) WHERE price_max_20 IS NOT NULL AND target IS NOT NULL",
    ),
)
def _(spark, sf_dir):
    return X.lag_features(ticks(spark, sf_dir)).select("symbol", "seq", "hour", "minute", "day_of_week", *_LAGS)


@query(
    "forward_label",
    f"WITH {BASE} " + rounded("symbol seq direction", "target magnitude", f"""(SELECT symbol, seq, CAST(ln(target / price) > 0 AS INT) AS direction, target, abs(ln(target / price)) AS magnitude
      FROM (SELECT *, lead(price, 5) OVER ({W}) AS target FROM b)) WHERE target IS NOT NULL"""),
)
def _(spark, sf_dir):
    return X.forward_label(ticks(spark, sf_dir)).select("symbol", "seq", "direction", "target", "magnitude")


@query("rolling_statistics", sql({f"price_{s}_20": roll(fn, "price", 20) for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median"))}))
def _(spark, sf_dir):
    return X.rolling_statistics(ticks(spark, sf_dir), "price", 20).drop(
        "ts", "price", "volume", "event_type", "side", "bid", "ask", "bid_volume", "ask_volume"
    )


BARS = f"""{TICKS}, q AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS bar FROM ticks),
 bars AS (SELECT symbol, bar, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
 sum(volume) AS volume, count(*) AS trades, sum(price * volume) / nullif(sum(volume), 0) AS vwap FROM q GROUP BY symbol, bar)"""


@query(
    "resample_ohlc",
    f"""WITH {BARS}, s AS (SELECT symbol, unnest(generate_series(min(bar), max(bar), INTERVAL '1 hour')) AS bar FROM bars GROUP BY symbol) """
    + rounded("symbol bar trades", "open high low close volume vwap", """(SELECT s.symbol, s.bar, coalesce(b.trades, 0) AS trades, b.open, b.high, b.low, b.close,
    coalesce(b.volume, 0) AS volume, b.vwap FROM s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar = s.bar)"""),
)
def _(spark, sf_dir):
    """Clean, then hourly bars with empty hours kept."""
    return B.ohlc(ticks(spark, sf_dir).filter("price > 0 and volume >= 0"), 3600)


@query(
    "resample_last_mean",
    f"WITH {TICKS} " + rounded("symbol bar", "price_last volume_last price_mean", """(SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS bar, arg_max(price, (ts, seq)) AS price_last,
     arg_max(volume, (ts, seq)) AS volume_last, avg(price) AS price_mean FROM ticks GROUP BY symbol, bar)"""),
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir)
    last = B.resample(t, 86_400, ["price", "volume"]).withColumnsRenamed({"price": "price_last", "volume": "volume_last"})
    mean = B.resample(t, 86_400, ["price"], "mean").withColumnRenamed("price", "price_mean")
    return last.join(mean, ["symbol", "bar"])


@query(
    "daily_stats",
    f"""WITH {TICKS} """ + rounded("symbol day trades", "open high low close volume return_pct range", """(SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS trades, arg_min(price, (ts, seq)) AS open,
     max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume,
     (arg_max(price, (ts, seq)) / nullif(arg_min(price, (ts, seq)), 0) - 1) * 100 AS return_pct, max(price) - min(price) AS range FROM ticks GROUP BY symbol, day)""", 5),
    digits=5,
)
def _(spark, sf_dir):
    return B.daily_stats(ticks(spark, sf_dir))


@query(
    "gap_and_session",
    f"""WITH {TICKS}, o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) < 7200000000 THEN 0 ELSE 1 END AS opens FROM ticks),
    s AS (SELECT *, sum(opens) OVER ({W} ROWS UNBOUNDED PRECEDING) AS session FROM o)
    SELECT symbol, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM s GROUP BY symbol, session""",
)
def _(spark, sf_dir):
    return X.sessions(ticks(spark, sf_dir), gap_seconds=7200)


@query(
    "ffill",
    f"""WITH {TICKS} """ + rounded("symbol seq", "price volume", f"""(SELECT symbol, seq, coalesce(last_value(CASE WHEN event_type <> 'error' THEN price END IGNORE NULLS) OVER w, 0) AS price,
      coalesce(last_value(CASE WHEN event_type = 'view' THEN volume END IGNORE NULLS) OVER w, 0) AS volume FROM ticks WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING))"""),
)
def _(spark, sf_dir):
    holes = ticks(spark, sf_dir).withColumns(
        {"price": F.when(F.col("event_type") != "error", F.col("price")), "volume": F.when(F.col("event_type") == "view", F.col("volume"))}
    )
    return X.forward_fill(holes, ["price", "volume"]).select("symbol", "seq", "price", "volume")


@query(
    "feature_registry",
    sql({"sma_10": roll("avg", "price", 10), "rsi_14": _rsi(14), "vwap_20": div(roll("sum", "notional", 20), roll("sum", "volume", 20)), "market_regime": "CAST(NULL AS DOUBLE)"}),
)
def _(spark, sf_dir):
    names = ["sma_10", "rsi_14", "vwap_20", "market_regime"]
    return X.compute(ticks(spark, sf_dir), names).select("symbol", "seq", *names)


_Z = div(f"ret - ({roll('avg', 'ret', 20)})", roll("stddev_samp", "ret", 20))


@query(
    "rolling_z_anomaly",
    f"WITH {BASE} " + rounded("symbol seq", "z", f"(SELECT symbol, seq, {_Z} AS z FROM b) WHERE abs(z) > 3 ORDER BY abs(z) DESC, seq LIMIT 5"),
)
def _(spark, sf_dir):
    """The five strongest, as the report shows them."""
    out = X.compute(ticks(spark, sf_dir), ["return_z", "return_anomaly"]).filter("return_anomaly")
    return out.select("symbol", "seq", F.col("return_z").alias("z")).orderBy(F.abs("z").desc(), "seq").limit(5)


@query(
    "volume_anomaly",
    sql({"volume_anomaly_z": f"CASE WHEN count(volume) OVER p >= 10 THEN CASE WHEN stddev_pop(volume) OVER p = 0 THEN 0 ELSE (volume - avg(volume) OVER p) / stddev_pop(volume) OVER p END END"},
        tail=f" WINDOW p AS ({W} ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)"),
)
def _(spark, sf_dir):
    return X.compute(ticks(spark, sf_dir), ["volume_anomaly_z"]).select("symbol", "seq", "volume_anomaly_z")


@query(
    "price_spike",
    f"WITH {BASE} SELECT symbol, seq, coalesce(abs(ret) > 0.05, FALSE) AS price_spike, CASE WHEN ret > 0.05 THEN 'up' WHEN ret < -0.05 THEN 'down' END AS spike_direction FROM b",
)
def _(spark, sf_dir):
    return X.compute(ticks(spark, sf_dir), ["price_spike", "spike_direction"]).select("symbol", "seq", "price_spike", "spike_direction")


_C5 = f"({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(
    "median_filter",
    sql({"filtered": f"CASE WHEN count(price) OVER {_C5} = 5 AND abs(price - median(price) OVER {_C5}) > 1.5 * stddev_pop(price) OVER {_C5} THEN median(price) OVER {_C5} ELSE price END"}),
)
def _(spark, sf_dir):
    return cleaning.median_filter(ticks(spark, sf_dir), sigmas=1.5).select("symbol", "seq", "filtered")


@query(
    "winsorise_returns",
    f"""WITH {BASE}, g AS (SELECT symbol, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM b WHERE ret IS NOT NULL GROUP BY symbol) """
    + rounded("symbol seq", "winsorised", "(SELECT b.symbol, b.seq, CASE WHEN ret < lo THEN prev * (1 + lo) WHEN ret > hi THEN prev * (1 + hi) ELSE price END AS winsorised FROM b LEFT JOIN g USING (symbol))", 5),
    digits=5,
)
def _(spark, sf_dir):
    return cleaning.winsorise_returns(ticks(spark, sf_dir)).select("symbol", "seq", "winsorised")


@query("rolling_correlation", sql({"rolling_corr": f"coalesce(CASE WHEN isnan(corr(price, volume) OVER {f(100)}) THEN NULL ELSE corr(price, volume) OVER {f(100)} END, 0)"}))
def _(spark, sf_dir):
    return X.rolling_correlation(ticks(spark, sf_dir), "price", "volume").select("symbol", "seq", "rolling_corr")


@query(
    "interval_gap",
    f"""WITH {TICKS} """ + rounded("symbol seq gap_start gap_end", "gap_ms", f"""(SELECT symbol, seq, lag(ts) OVER ({W}) AS gap_start, ts AS gap_end,
     (epoch_us(ts) - lag(epoch_us(ts)) OVER ({W})) / CAST(1000 AS DOUBLE) AS gap_ms FROM ticks) WHERE gap_ms > 1.5 * 36000000""", 3),
    digits=3,
)
def _(spark, sf_dir):
    return X.interval_gaps(ticks(spark, sf_dir), expected_ms=36_000_000).select("symbol", "seq", "gap_start", "gap_end", "gap_ms")


def _bar_roll(fn: str, col: str, n: int) -> str:
    fr = f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {fr} >= {n} THEN {fn}({col}) OVER {fr} END"


_BW = "(PARTITION BY symbol ORDER BY bar)"
_WILDER = "sum(p.{x} * pow(1 - 1 / CAST(14 AS DOUBLE), t.i - p.i) * CASE WHEN p.i = 1 THEN 1 ELSE 1 / CAST(14 AS DOUBLE) END)"


@query(
    "classic_indicators",
    f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER {_BW} AS pc, high - lag(high) OVER {_BW} AS up, lag(low) OVER {_BW} - low AS down,
      row_number() OVER {_BW} AS i, (high + low + close) / 3 AS tp FROM bars),
    y AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus,
      CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus, {_bar_roll('max', 'high', 14)} AS top, {_bar_roll('min', 'low', 14)} AS bot,
      {_bar_roll('avg', 'tp', 20)} AS tpm FROM x),
    z AS (SELECT *, (close - bot) / nullif(top - bot, 0) * 100 AS k, (top - close) / nullif(top - bot, 0) * -100 AS wr, {_bar_roll('avg', 'tr', 14)} AS atr FROM y),
    k AS (SELECT *, {_bar_roll('avg', 'k', 3)} AS d FROM z),
    md AS (SELECT t.symbol, t.i, sum(abs(p.tp - t.tpm)) / 20 AS dev FROM y t JOIN y p ON p.symbol = t.symbol AND p.i BETWEEN t.i - 19 AND t.i WHERE t.tpm IS NOT NULL GROUP BY t.symbol, t.i),
    s AS (SELECT t.symbol, t.i, {_WILDER.format(x='tr')} AS s_tr, {_WILDER.format(x='plus')} AS s_plus, {_WILDER.format(x='minus')} AS s_minus
      FROM y t JOIN y p ON p.symbol = t.symbol AND p.i <= t.i GROUP BY t.symbol, t.i),
    dx AS (SELECT symbol, i, coalesce(abs(s_plus / nullif(s_tr, 0) - s_minus / nullif(s_tr, 0)) / nullif(s_plus / nullif(s_tr, 0) + s_minus / nullif(s_tr, 0), 0), 0) * 100 AS v FROM s),
    ax AS (SELECT t.symbol, t.i, {_WILDER.format(x='v')} AS adx FROM dx t JOIN dx p ON p.symbol = t.symbol AND p.i <= t.i GROUP BY t.symbol, t.i) """
    + rounded("symbol bar", "stoch_k stoch_d williams_r cci atr adx", """(SELECT k.symbol, k.bar, k.k AS stoch_k, k.d AS stoch_d, k.wr AS williams_r,
      (k.tp - k.tpm) / nullif(md.dev * 0.015, 0) AS cci, k.atr, ax.adx FROM k LEFT JOIN md ON md.symbol = k.symbol AND md.i = k.i JOIN ax ON ax.symbol = k.symbol AND ax.i = k.i)""", 5),
    digits=5,
)
def _(spark, sf_dir):
    bars = B.ohlc(ticks(spark, sf_dir), 3600, fill_empty=False)
    return B.classic_indicators(bars).select("symbol", "bar", "stoch_k", "stoch_d", "williams_r", "cci", "atr", "adx")
