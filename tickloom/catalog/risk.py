"""Positions, profit and risk."""

from pyspark.sql import functions as F

from tickloom.catalog.aggregates import COV, RETURNS, day_returns
from tickloom.catalog.books import LIMITS, _FIFO, net_positions, scenarios
from tickloom.catalog.registry import TICKS, TRADES, TRADE_SORT, W, query, rounded
from tickloom.operators import pnl as P
from tickloom.operators import risk as R
from tickloom.plans.shuffling import mixed_sql
from tickloom.sources.standins import TRADE_ORDER, table, ticks, trades

_TW = f"PARTITION BY symbol ORDER BY {TRADE_SORT}"


@query(
    "fifo_pnl",
    f"WITH {_FIFO} SELECT symbol, sell_ts AS ts, sell_order AS order_id, sell_line AS line_no, round(sell_volume, 4) AS volume, round(sum((sell_price - buy_price) * overlap), 3) AS pnl, round(sum(overlap), 3) AS matched, count(*) AS lots FROM ov WHERE overlap > 0 GROUP BY ALL",
    digits=3,
)
def _(spark, sf_dir):
    return P.fifo_pnl(trades(spark, sf_dir), order=TRADE_ORDER).select("symbol", "ts", "order_id", "line_no", "volume", "pnl", "matched", "lots")


@query(
    "cash_and_position",
    f"WITH {TRADES} SELECT symbol, order_id, line_no, round(sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) OVER w, 3) AS position, round(sum(CASE WHEN side = 'bid' THEN -volume * price ELSE volume * price END) OVER w, 3) AS cash FROM trades WINDOW w AS ({_TW} ROWS UNBOUNDED PRECEDING)",
    digits=3,
)
def _(spark, sf_dir):
    return P.cash_and_position(trades(spark, sf_dir), order=TRADE_ORDER).select("symbol", "order_id", "line_no", "position", "cash")


_FILLS = f"""{TICKS}, fl AS (SELECT *, CASE WHEN side = 'bid' THEN volume ELSE -volume END AS q FROM ticks WHERE event_type IN ('purchase', 'signup')),
  cp AS (SELECT symbol, ts, seq, sum(q) OVER w AS position, sum(-q * price) OVER w AS cash FROM fl WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)), qs AS (SELECT * FROM ticks WHERE event_type NOT IN ('purchase', 'signup'))"""


def _fills_and_quotes(spark, sf_dir):
    t = ticks(spark, sf_dir)
    own = F.col("event_type").isin("purchase", "signup")
    return t.filter(own), t.filter(~own)


@query(
    "equity_curve",
    f"WITH {_FILLS} " + rounded("symbol seq", "position cash mid_price spread value", """(SELECT q.symbol, q.seq, coalesce(c.position, 0) AS position, coalesce(c.cash, 0) + 1000 AS cash, (q.bid + q.ask) / 2 AS mid_price,
    q.ask - q.bid AS spread, coalesce(c.cash, 0) + 1000 + coalesce(c.position, 0) * (q.bid + q.ask) / 2 AS value FROM qs q ASOF LEFT JOIN cp c ON q.symbol = c.symbol AND q.ts >= c.ts)""", 4),
    digits=4,
)
def _(spark, sf_dir):
    own, quotes = _fills_and_quotes(spark, sf_dir)
    return P.equity_curve(quotes, own, start_cash=1000.0).select("symbol", "seq", "position", "cash", "mid_price", "spread", "value")


AVG_COST = f"""{TRADES}, nt AS (SELECT *, row_number() OVER ({_TW}) AS i, CASE WHEN side = 'bid' THEN volume ELSE -volume END AS q FROM trades),
  ac AS (SELECT symbol, i, order_id, line_no, ts, q AS pos, price AS avg, CAST(0 AS DOUBLE) AS realized, CAST(0 AS DOUBLE) AS total FROM nt WHERE i = 1 UNION ALL
    SELECT n.symbol, n.i, n.order_id, n.line_no, n.ts, a.pos + n.q,
      CASE WHEN abs(a.pos + n.q) < 1e-9 THEN 0 WHEN abs(a.pos) < 1e-9 THEN n.price WHEN a.pos * n.q > 0 THEN (a.pos * a.avg + n.q * n.price) / (a.pos + n.q)
           WHEN abs(n.q) > abs(a.pos) THEN n.price ELSE a.avg END,
      CASE WHEN a.pos * n.q < 0 THEN least(abs(a.pos), abs(n.q)) * (n.price - a.avg) * sign(a.pos) ELSE 0 END,
      a.total + CASE WHEN a.pos * n.q < 0 THEN least(abs(a.pos), abs(n.q)) * (n.price - a.avg) * sign(a.pos) ELSE 0 END
    FROM ac a JOIN nt n ON n.symbol = a.symbol AND n.i = a.i + 1)"""


def average_cost(spark, sf_dir):
    return P.average_cost(trades(spark, sf_dir), order=TRADE_ORDER)


@query(
    "avg_cost_position",
    f"WITH RECURSIVE {AVG_COST} SELECT symbol, order_id, line_no, round(pos, 3) AS position, round(avg, 3) AS average_price, round(realized, 3) AS realized, round(total, 3) AS realized_pnl FROM ac",
    digits=3,
)
def _(spark, sf_dir):
    return average_cost(spark, sf_dir).select("symbol", "order_id", "line_no", "position", "average_price", "realized", "realized_pnl")


POS = "po AS (SELECT symbol, arg_max(pos, i) AS qty, arg_max(avg, i) AS avg_price, arg_max(total, i) AS realized_pnl FROM ac GROUP BY symbol)"


def positions(spark, sf_dir):
    """Closing position per symbol: qty, avg_price, realized_pnl."""
    last = P.last_state(average_cost(spark, sf_dir), order=TRADE_ORDER, columns=("position", "average_price", "realized_pnl"))
    return last.withColumnsRenamed({"position": "qty", "average_price": "avg_price"})


MARKS = "mk AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS mark_price FROM part)"


def marks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("mark_price"))


@query(
    "mark_to_market",
    f"WITH RECURSIVE {AVG_COST}, {POS}, {MARKS} SELECT symbol, round(qty, 3) AS qty, round(avg_price, 3) AS avg_price, round(qty * coalesce(mark_price, avg_price), 3) AS market_value, round((coalesce(mark_price, avg_price) - avg_price) * qty, 3) AS unrealized_pnl, round(realized_pnl, 3) AS realized_pnl FROM po LEFT JOIN mk USING (symbol)",
    digits=3,
)
def _(spark, sf_dir):
    return P.mark_to_market(positions(spark, sf_dir), marks(spark, sf_dir)).select(
        "symbol", "qty", "avg_price", "market_value", "unrealized_pnl", "realized_pnl"
    )


@query(
    "position_totals",
    f"""WITH RECURSIVE {AVG_COST}, {POS}, {MARKS}, m AS (SELECT qty, qty * mark_price AS mv, (mark_price - avg_price) * qty AS u, realized_pnl FROM po JOIN mk USING (symbol))
    SELECT count(*) FILTER (qty <> 0) AS open_positions, round(sum(mv), 1) AS net_value, round(sum(abs(mv)), 1) AS gross_value, round(sum(u), 1) AS unrealized_pnl, round(sum(realized_pnl), 1) AS realized_pnl FROM m""",
    digits=1,
)
def _(spark, sf_dir):
    return P.position_totals(P.mark_to_market(positions(spark, sf_dir), marks(spark, sf_dir)))


_DD = f"""{TICKS}, p AS (SELECT *, max(price) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM ticks),
  f AS (SELECT *, peak - price AS fall, CASE WHEN peak > 0 THEN (peak - price) / peak END AS share FROM p),
  k AS (SELECT *, last_value(CASE WHEN fall = 0 THEN ts END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS pk FROM f)"""


@query("drawdown", f"WITH {_DD} SELECT symbol, round(max(fall), 6) AS max_drawdown_money, round(max(share), 6) AS max_drawdown, arg_max(pk, (share, -epoch_us(ts))) AS peak_ts, arg_max(ts, (share, -epoch_us(ts))) AS trough_ts FROM k GROUP BY symbol")
def _(spark, sf_dir):
    return R.drawdown(ticks(spark, sf_dir), "price")


_PD = f"""{RETURNS}, c AS (SELECT symbol, bar, sum(ret) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS s FROM rt WHERE ret IS NOT NULL),
  m AS (SELECT *, max(s) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) AS top FROM c), dd AS (SELECT symbol, min(s - top) AS d FROM m GROUP BY symbol)"""


@query("pnl_drawdown", f"WITH {_PD} SELECT symbol, round(d, 6) AS pnl_drawdown FROM dd")
def _(spark, sf_dir):
    return R.pnl_drawdown(day_returns(spark, sf_dir), order=("bar",))


@query(
    "sharpe",
    f"""WITH {RETURNS} SELECT symbol, round(CASE WHEN stddev_samp(ret) IS NULL OR stddev_samp(ret) = 0 THEN 0 ELSE (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) END, 5) AS sharpe,
    round(CASE WHEN stddev_pop(ret) IS NULL OR stddev_pop(ret) = 0 THEN 0 ELSE (avg(ret) - 0.02 / 252) / stddev_pop(ret) * sqrt(252) END, 5) AS sharpe_population FROM rt GROUP BY symbol""",
    digits=5,
)
def _(spark, sf_dir):
    r = day_returns(spark, sf_dir)
    both = R.sharpe(r, risk_free=0.02, population=True).withColumnRenamed("sharpe", "sharpe_population")
    return R.sharpe(r, risk_free=0.02).join(both, "symbol")


@query("sortino", f"WITH {RETURNS} SELECT symbol, round(CASE WHEN coalesce(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0) = 0 THEN 0 ELSE avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) END, 5) AS sortino FROM rt GROUP BY symbol", digits=5)
def _(spark, sf_dir):
    return R.sortino(day_returns(spark, sf_dir))


@query("calmar", f"WITH {_PD}, a AS (SELECT symbol, avg(ret) * 252 AS y FROM rt GROUP BY symbol) SELECT symbol, round(coalesce(y / nullif(abs(d), 0), 0), 5) AS calmar FROM a JOIN dd USING (symbol)", digits=5)
def _(spark, sf_dir):
    return R.calmar(day_returns(spark, sf_dir), order=("bar",))


MARKET = "mr AS (SELECT bar, avg(ret) AS market FROM rt GROUP BY bar)"


def market_returns(spark, sf_dir):
    """Equal-weighted mean return per day."""
    return day_returns(spark, sf_dir).groupBy("bar").agg(F.avg("ret").alias("market"))


@query(
    "information_ratio",
    f"WITH {RETURNS}, {MARKET}, x AS (SELECT symbol, ret - market AS e FROM rt JOIN mr USING (bar)) SELECT symbol, count(e) AS n, round(CASE WHEN coalesce(stddev_pop(e), 0) = 0 THEN 0 ELSE avg(e) / stddev_pop(e) * sqrt(252) END, 5) AS information_ratio FROM x GROUP BY symbol",
    digits=5,
)
def _(spark, sf_dir):
    bench = market_returns(spark, sf_dir).withColumnRenamed("market", "bench")
    return R.information_ratio(day_returns(spark, sf_dir), bench)


@query("tail_ratio", f"WITH {RETURNS} SELECT symbol, round(abs(quantile_cont(ret, 0.95)) / nullif(abs(quantile_cont(ret, 0.05)), 0), 5) AS tail_ratio FROM rt WHERE ret IS NOT NULL GROUP BY symbol", digits=5)
def _(spark, sf_dir):
    return R.tail_ratio(day_returns(spark, sf_dir))


@query("win_rate", f"WITH {_FIFO}, cl AS (SELECT symbol, sell_ts, sell_order, sell_line, sell_volume, sell_price, sum((sell_price - buy_price) * overlap) AS pnl FROM ov WHERE overlap > 0 GROUP BY ALL) SELECT symbol, count(*) FILTER (abs(pnl) > 1e-6) AS closes, round(coalesce(count(*) FILTER (pnl > 1e-6) / CAST(nullif(count(*) FILTER (abs(pnl) > 1e-6), 0) AS DOUBLE), 0), 6) AS win_rate FROM cl GROUP BY symbol")
def _(spark, sf_dir):
    closes = P.fifo_pnl(trades(spark, sf_dir), order=TRADE_ORDER)
    # Profits within a millionth of zero are rounding noise.
    settled = closes.withColumn("pnl", F.when(F.abs("pnl") > 1e-6, F.col("pnl")).otherwise(F.lit(0.0)))
    return R.win_rate(settled)


@query(
    "rolling_sharpe",
    f"""WITH {RETURNS} SELECT symbol, bar, round(CASE WHEN count(ret) OVER w >= 20 THEN CASE WHEN stddev_samp(ret) OVER w = 0 THEN 0 ELSE avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END END, 5) AS rolling_sharpe,
    round((exp(coalesce(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), 0)) - 1) * 100, 4) AS cumulative_return_pct FROM rt WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""".replace(", 5) AS rolling", ", 4) AS rolling"),
    digits=4,
)
def _(spark, sf_dir):
    return R.rolling_sharpe(day_returns(spark, sf_dir), n=20, order=("bar",)).drop("ret")


_WEIGHTS = "wt AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume WHEN side = 'ask' THEN -volume ELSE 0 END) AS weight FROM ticks GROUP BY symbol)"


def weights(spark, sf_dir):
    flow = F.when(F.col("side") == "bid", F.col("volume")).when(F.col("side") == "ask", -F.col("volume")).otherwise(F.lit(0.0))
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.sum(flow).alias("weight"))


@query(
    "var_es_parametric",
    f"""WITH {COV}, {_WEIGHTS}, v AS (SELECT sqrt(greatest(sum(CASE WHEN a = b THEN 1 ELSE 2 END * x.weight * y.weight * covar), 0)) AS sigma FROM cv JOIN wt x ON x.symbol = a JOIN wt y ON y.symbol = b)
    SELECT round(sigma, 4) AS sigma, round(sigma * 1.6448536269514722, 4) AS var, round(sigma * exp(-1.6448536269514722 * 1.6448536269514722 / 2) / sqrt(2 * pi()) / 0.05, 4) AS expected_shortfall FROM v""",
    digits=4,
)
def _(spark, sf_dir):
    return R.var_es_parametric(day_returns(spark, sf_dir), weights(spark, sf_dir))


@query(
    "var_historical",
    f"""WITH {RETURNS}, {_WEIGHTS}, q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q FROM rt WHERE ret IS NOT NULL GROUP BY symbol), n AS (SELECT symbol, count(*) AS n FROM rt GROUP BY symbol)
    SELECT symbol, weight * 100 AS position_value, round(CASE WHEN n > 20 THEN coalesce(abs(weight * 100 * q), 0) ELSE 0 END, 4) AS var FROM wt LEFT JOIN n USING (symbol) LEFT JOIN q USING (symbol)""",
    digits=4,
)
def _(spark, sf_dir):
    held = weights(spark, sf_dir).select("symbol", (F.col("weight") * 100).alias("position_value"))
    return R.var_historical(day_returns(spark, sf_dir), held)


@query(
    "var_bootstrap",
    f"""WITH {RETURNS}, {_WEIGHTS}, dp AS (SELECT bar, sum(coalesce(ret, 0) * weight) AS pnl FROM rt JOIN wt USING (symbol) GROUP BY bar),
    dn AS (SELECT pnl, row_number() OVER (ORDER BY bar) - 1 AS day FROM dp), dz AS (SELECT count(*) AS days FROM dn),
    pk AS (SELECT id // 10 AS draw, {mixed_sql('id', '7')} % days AS day FROM (SELECT unnest(range(100000)) AS id), dz),
    ts AS (SELECT draw, sum(pnl) AS total FROM pk JOIN dn USING (day) GROUP BY draw), ct AS (SELECT quantile_cont(total, 0.05) AS cut FROM ts)
    SELECT count(*) AS draws, round(-max(cut), 4) AS var, round(coalesce(-avg(total) FILTER (total <= cut), 0), 4) AS expected_shortfall FROM ts, ct""",
    digits=4,
)
def _(spark, sf_dir):
    day = day_returns(spark, sf_dir).join(weights(spark, sf_dir), "symbol").groupBy("bar").agg(
        F.sum(F.coalesce("ret", F.lit(0.0)) * F.col("weight")).alias("pnl")
    )
    return R.var_bootstrap(day, draws=10_000, horizon=10)


@query(
    "portfolio_beta",
    f"""WITH {RETURNS}, {MARKET}, {_WEIGHTS}, b AS (SELECT symbol, covar_samp(ret, market) / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN market END), 0) AS beta FROM rt JOIN mr USING (bar) GROUP BY symbol)
    SELECT round(sum(abs(weight) / (SELECT sum(abs(weight)) FROM wt) * beta), 5) AS portfolio_beta FROM wt JOIN b USING (symbol)""",
    digits=5,
)
def _(spark, sf_dir):
    return R.portfolio_beta(day_returns(spark, sf_dir), market_returns(spark, sf_dir), weights(spark, sf_dir))


@query(
    "stress_test",
    f"""WITH {TRADES}, ps AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) AS qty, max(price) AS top FROM trades GROUP BY symbol),
    sc AS (SELECT r_name AS scenario, n_nationkey AS grp, (n_nationkey - 12) / CAST(100 AS DOUBLE) AS shock FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT scenario, round(sum(coalesce(qty * top * shock, 0)), 1) AS pnl FROM sc LEFT JOIN ps ON CAST(symbol AS BIGINT) % 25 = grp GROUP BY scenario""",
    digits=1,
)
def _(spark, sf_dir):
    held = net_positions(spark, sf_dir).select((F.col("symbol").cast("long") % 25).alias("grp"), (F.col("qty") * F.col("top")).alias("market_value"))
    return R.stress_test(held, scenarios(spark, sf_dir), on="grp")


@query(
    "position_sizing",
    f"""WITH {TICKS}, {_WEIGHTS}, h AS (SELECT sum(abs(weight * 10)) / CAST(1000000 AS DOUBLE) AS heat FROM wt),
    s AS (SELECT symbol, seq, price, (volume - 50) / 50 AS strength, volume / 100 AS volatility FROM ticks),
    z AS (SELECT *, 1000000 * 0.1 * abs(strength) * least(2, greatest(0.1, 1 / greatest(0.01, volatility * 10))) * greatest(0.1, 1 - heat) AS v FROM s, h)
    SELECT symbol, seq, CAST(CASE WHEN strength < 0 THEN -least(floor(v / price), floor(1000000 / price)) ELSE least(floor(v / price), floor(1000000 / price)) END AS BIGINT) AS size FROM z""",
)
def _(spark, sf_dir):
    s = ticks(spark, sf_dir).select("symbol", "seq", "price", ((F.col("volume") - 50) / 50).alias("strength"), (F.col("volume") / 100).alias("volatility"))
    held = weights(spark, sf_dir).select("symbol", (F.col("weight") * 10).alias("market_value"))
    return R.position_sizing(s, held, capital=1e6).select("symbol", "seq", "size")


@query(
    "risk_score",
    f"""WITH {_DD}, {_WEIGHTS}, d AS (SELECT symbol, max(share) AS dd, stddev_pop(ret) * sqrt(252) AS vol FROM (SELECT *, price / lag(price) OVER ({W}) - 1 AS ret FROM k) GROUP BY symbol),
    s AS (SELECT symbol, least(100, abs(weight) / 100000 * 100 + dd * 0.1 * 200 + least(vol, 1) * 50) AS score FROM d JOIN wt USING (symbol))
    SELECT symbol, round(score, 5) AS score, CASE WHEN score < 20 THEN 'low' WHEN score < 50 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'critical' END AS level FROM s""",
    digits=5,
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir)
    vol = R.with_returns(t, "price").groupBy("symbol").agg((F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("vol"))
    d = R.drawdown(t, "price").join(vol, "symbol").join(weights(spark, sf_dir), "symbol")
    score, level = R.risk_score(F.abs("weight") / 100000, F.col("max_drawdown") * 0.1, F.least("vol", F.lit(1.0)))
    return d.select("symbol", score.alias("score"), level.alias("level"))


_MARKET_FACTS = "mf AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_size / CAST(80 AS DOUBLE) AS volatility, p_size / CAST(4000 AS DOUBLE) AS spread_share FROM part)"


@query(
    "limit_checks",
    f"""WITH {TRADES}, ps AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) AS qty, max(price) AS top FROM trades GROUP BY symbol), {LIMITS}, {_MARKET_FACTS},
    t AS (SELECT sum(abs(qty * top)) AS exposure, sum(-10) AS pnl FROM ps),
    f AS (SELECT r.symbol, r.order_id, r.line_no, r.price * r.volume AS val, abs(coalesce(qty, 0) + CASE WHEN side = 'bid' THEN r.volume ELSE -r.volume END) AS size, r.price, own, volatility, spread_share, exposure, pnl
      FROM trades r LEFT JOIN ps ON ps.symbol = r.symbol LEFT JOIN lm ON lm.symbol = r.symbol LEFT JOIN mf ON mf.symbol = r.symbol, t),
    v AS (SELECT *, val > 60000 AS a, coalesce(size > own, FALSE) OR size * price > 300000 AS b, exposure + val > 1e12 AS c, -pnl > 1000 AS d, volatility > 0.5 AS e, spread_share > 0.01 AS g FROM f)
    SELECT symbol, order_id, line_no, round(val, 2) AS order_value, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) + CAST(g AS INT) AS violations,
    CAST(least(100, 25 * (CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT)) + 40 * CAST(d AS INT) + 15 * (CAST(e AS INT) + CAST(g AS INT))) AS DOUBLE) AS risk_score,
    NOT (a OR b OR c OR d OR e OR g) AS approved FROM v""",
    digits=2,
)
def _(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "symbol", "order_id", "line_no", (F.col("price") * F.col("volume")).alias("order_value"), F.size("violations").alias("violations"), "risk_score", "approved"
    )


def _checked(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("symbol", F.col("p_partkey").cast("string"))
    held = net_positions(spark, sf_dir).select("symbol", "qty", F.col("top").alias("avg_price"), F.lit(-10.0).alias("pnl"))
    own = part.filter("p_size > 40").select("symbol", (F.col("p_size") * 3.0).alias("own_limit"))
    facts = part.select("symbol", (F.col("p_size") / 80.0).alias("volatility"), (F.col("p_size") / 4000.0).alias("spread_share"))
    return R.check_orders(trades(spark, sf_dir), held, own, facts, max_order=60000.0, max_position_value=300000.0, max_exposure=1e12, max_loss=1000.0)


@query(
    "limit_violations",
    f"""WITH {TRADES}, ps AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) AS qty, max(price) AS top FROM trades GROUP BY symbol), {LIMITS}, {_MARKET_FACTS},
    t AS (SELECT sum(abs(qty * top)) AS exposure, sum(-10) AS pnl FROM ps),
    f AS (SELECT r.price * r.volume AS val, abs(coalesce(qty, 0) + CASE WHEN side = 'bid' THEN r.volume ELSE -r.volume END) AS size, r.price, own, volatility, spread_share, exposure, pnl
      FROM trades r LEFT JOIN ps ON ps.symbol = r.symbol LEFT JOIN lm ON lm.symbol = r.symbol LEFT JOIN mf ON mf.symbol = r.symbol, t),
    x AS (SELECT 'order_size_limit' AS kind, 'high' AS level, 'Order blocked' AS action, val - 60000 AS over FROM f
      UNION ALL SELECT 'position_limit', 'high', 'Order blocked', CASE WHEN size > own THEN size - own ELSE size * price - 300000 END FROM f
      UNION ALL SELECT 'exposure_limit', 'high', 'Order blocked', exposure + val - 1e12 FROM f
      UNION ALL SELECT 'loss_limit', 'critical', 'Trading halted', -pnl - 1000 FROM f
      UNION ALL SELECT 'volatility_limit', 'medium', 'Order flagged', volatility - 0.5 FROM f
      UNION ALL SELECT 'liquidity_limit', 'medium', 'Order flagged', spread_share - 0.01 FROM f)
    SELECT kind, level, action, count(*) AS n, round(sum(over), 1) AS excess FROM x WHERE over > 0 GROUP BY ALL""",
    digits=1,
)
def _(spark, sf_dir):
    rows = R.violation_rows(_checked(spark, sf_dir), ["order_id"])
    return rows.groupBy("kind", "level", "action").agg(F.count("*").alias("n"), F.sum("excess").alias("excess"))


@query(
    "limit_scan",
    f"""WITH {TRADES}, ps AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) AS qty, max(price) AS top FROM trades GROUP BY symbol), {LIMITS},
    x AS (SELECT symbol, 'position_limit' AS kind, 'high' AS level, abs(qty * top) AS current, own * 1000 AS lim FROM ps JOIN lm USING (symbol) WHERE abs(qty * top) > own * 1000
      UNION ALL SELECT NULL, 'exposure_limit', 'high', sum(abs(qty * top)), 1000000 FROM ps HAVING sum(abs(qty * top)) > 1000000)
    SELECT symbol, kind, level, round(current, 1) AS current, round(lim, 1) AS "limit", round(current - lim, 1) AS excess FROM x""",
    digits=1,
)
def _(spark, sf_dir):
    held = net_positions(spark, sf_dir).select("symbol", "qty", F.col("top").alias("avg_price"))
    own = table(spark, sf_dir, "part").filter("p_size > 40").select(
        F.col("p_partkey").cast("string").alias("symbol"), (F.col("p_size") * 3000.0).alias("own_limit")
    )
    return R.limit_scan(held, own, max_exposure=1e6)


@query(
    "position_risk",
    f"WITH {TICKS}, {_WEIGHTS}, m AS (SELECT symbol, arg_max(price, (ts, seq)) AS p, arg_max(volume, (ts, seq)) / 100 AS v FROM ticks GROUP BY symbol) SELECT symbol, round(abs(weight * p), 4) AS position_value, round(abs(weight * p) * v / sqrt(252) * 1.96, 4) AS daily_var, round(least(100, v * 100), 4) AS risk_score FROM wt JOIN m USING (symbol)",
    digits=4,
)
def _(spark, sf_dir):
    last = P.last_state(ticks(spark, sf_dir), columns=("price", "volume"))
    figures = R.position_risk(F.col("weight"), F.col("price"), F.col("volume") / 100)
    return weights(spark, sf_dir).join(last, "symbol").select("symbol", *[v.alias(n) for n, v in figures.items()])


@query(
    "maker_performance",
    f"""WITH {_FILLS}, o AS (SELECT *, sum(q) OVER ({W} ROWS UNBOUNDED PRECEDING) AS position, price - 50 AS pnl, volume > 60 AS adverse, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS r FROM fl),
    s AS (SELECT symbol, count(*) AS orders FROM ticks GROUP BY symbol)
    SELECT symbol, round(sum(pnl), 5) AS total_pnl, round(avg(pnl), 5) AS pnl_per_trade, round(count(*) / CAST(any_value(orders) AS DOUBLE), 5) AS fill_rate,
    round(CASE WHEN count(*) FILTER (r <= 20) > 10 THEN avg(CAST(adverse AS INT)) FILTER (r <= 20) ELSE 0 END, 5) AS adverse_selection_rate, round(abs(arg_max(position, (ts, seq))) / 1000, 5) AS risk_score
    FROM o JOIN s USING (symbol) GROUP BY symbol""",
    digits=5,
)
def _(spark, sf_dir):
    own, _ = _fills_and_quotes(spark, sf_dir)
    state = P.cash_and_position(own).withColumns({"pnl": F.col("price") - 50, "adverse": F.col("volume") > 60})
    sent = ticks(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("orders"))
    return R.maker_performance(state, sent, max_inventory=1000.0)


_BUY = "side = 'bid'"
_COST = f"""{TICKS}, od AS (SELECT *, CASE WHEN event_type IN ('purchase', 'view') THEN 'market' ELSE 'limit' END AS kind, (bid + ask) / 2 AS mid, ask - bid AS spread, volume + 1 AS size,
    price + CASE WHEN seq % 2 = 0 THEN 0.5 ELSE -0.5 END AS lp FROM ticks WHERE side IS NOT NULL),
  im AS (SELECT *, CASE WHEN {_BUY} THEN 1 ELSE -1 END * (spread / mid) * sqrt(size / 1000) * mid AS impact FROM od),
  ex AS (SELECT *, CASE WHEN kind = 'market' THEN CASE WHEN {_BUY} THEN ask ELSE bid END + impact WHEN {_BUY} AND lp >= ask THEN least(lp, ask) WHEN side = 'ask' AND lp <= bid THEN greatest(lp, bid) ELSE lp END AS px FROM im)"""


@query(
    "transaction_cost_estimate",
    f"WITH {_COST} " + rounded("symbol seq", "market_impact execution_price slippage fill_probability volatility_score liquidity_score", f"""(SELECT symbol, seq, impact AS market_impact, px AS execution_price,
    CASE WHEN kind = 'market' THEN abs(px - mid) ELSE greatest(0, CASE WHEN {_BUY} THEN px - lp ELSE lp - px END) END + 0.0001 * mid * sqrt(size / 1000) AS slippage,
    CASE WHEN kind = 'market' THEN 0.95 * (1 - 0.3 * least(1, size / CASE WHEN {_BUY} THEN ask_volume ELSE bid_volume END)) ELSE 0.95 * CASE WHEN ({_BUY} AND lp >= ask) OR (side = 'ask' AND lp <= bid) THEN 0.9 ELSE 0.3 END END AS fill_probability,
    least(1, (spread / mid) / 0.005) AS volatility_score, least(1, (bid_volume + ask_volume) / 10000) AS liquidity_score FROM ex)"""),
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir).filter(F.col("side").isNotNull()).withColumns(
        {
            "order_type": F.when(F.col("event_type").isin("purchase", "view"), "market").otherwise("limit"), "volume": F.col("volume") + 1,
            "price": F.col("price") + F.when(F.col("seq") % 2 == 0, 0.5).otherwise(-0.5),
        }
    )
    return R.transaction_costs(t).select(
        "symbol", "seq", "market_impact", "execution_price", "slippage", "fill_probability", "volatility_score", "liquidity_score"
    )
