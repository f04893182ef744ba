"""Signal tables, pairs, venues, options."""

from pyspark.sql import functions as F

from tickloom.catalog.books import DAY_BARS, PAIRS, TYPE_BARS, day_bars, type_bars
from tickloom.catalog.features import BASE, f, lagged, roll
from tickloom.catalog.registry import TICKS, TRADES, W, query, rounded
from tickloom.catalog.risk import weights
from tickloom.operators import joins as J
from tickloom.operators import options as O
from tickloom.operators import signals as G
from tickloom.plans.series import broadcast_if_small, windowed
from tickloom.sources.standins import table, ticks, trades


def _clip(x: str) -> str:
    return f"least(greatest({x}, -1), 1)"


_MOM = f"""mo AS (SELECT symbol, ts, seq, coalesce(price / {lagged('price', 5)} - 1, 0) AS short, coalesce(price / {lagged('price', 10)} - 1, 0) AS long,
  count(*) OVER {f(10)} AS seen, count(*) FILTER (diff > 0) OVER {f(9)} AS ups, count(*) FILTER (diff < 0) OVER {f(9)} AS downs FROM b),
 m1 AS (SELECT symbol, ts, seq, 'momentum' AS kind, {_clip('(short * 0.7 + long * 0.3) * 10')} AS strength, CASE WHEN short * 0.7 + long * 0.3 > 0 THEN ups ELSE downs END / CAST(9 AS DOUBLE) AS confidence
  FROM mo WHERE seen >= 10 AND abs(short * 0.7 + long * 0.3) > 0.001)"""
_REV = f"""mr0 AS (SELECT *, {roll('avg', 'price', 20)} AS m, {roll('stddev_pop', 'price', 20)} AS s FROM b),
 m2 AS (SELECT symbol, ts, seq, 'mean_reversion' AS kind, {_clip('(m - price) / m * 5')} AS strength, least(1, s / m * 20) AS confidence FROM mr0 WHERE abs((m - price) / m) > 0.005)"""
_FLOW = """m3 AS (SELECT symbol, ts, seq, 'order_flow' AS kind, imbalance * 0.8 AS strength, least(1, (bid_volume + ask_volume) / 10000) AS confidence FROM b WHERE abs(imbalance) > 0.2)"""
_MICRO = f"""mi0 AS (SELECT *, spread / mid AS pct FROM b), mi AS (SELECT *, {roll('avg', 'pct', 10)} AS m FROM mi0),
 m4 AS (SELECT symbol, ts, seq, 'microstructure' AS kind, {_clip('(pct - m) / m * -0.5')} AS strength, least(1, abs((pct - m) / m)) AS confidence FROM mi WHERE abs((pct - m) / m) > 0.3)"""
_TECH = f"""te0 AS (SELECT *, avg(price) OVER {f(10)} AS s, avg(price) OVER {f(20)} AS l, count(*) OVER {f(50)} AS n FROM b),
 te AS (SELECT *, (price - s) / s AS x, (price - l) / l AS y, (s - l) / l AS z FROM te0),
 m5 AS (SELECT symbol, ts, seq, 'technical' AS kind, {_clip('(x * 0.4 + y * 0.3 + z * 0.3) * 5')} AS strength, CASE WHEN sign(x) = sign(y) AND sign(y) = sign(z) THEN 0.8 ELSE 0.4 END AS confidence
  FROM te WHERE n >= 50 AND abs(x * 0.4 + y * 0.3 + z * 0.3) > 0.01)"""


def _sig(cte: str, name: str) -> str:
    return f"WITH {BASE}, {cte} " + rounded("symbol seq kind", "strength confidence", name)


_COLS = ("symbol", "seq", "kind", "strength", "confidence")


@query("sig_momentum", _sig(_MOM, "m1"))
def _(spark, sf_dir):
    return G.momentum(ticks(spark, sf_dir)).select(*_COLS)


@query("sig_mean_reversion", _sig(_REV, "m2"))
def _(spark, sf_dir):
    return G.mean_reversion(ticks(spark, sf_dir)).select(*_COLS)


@query("sig_order_flow", _sig(_FLOW, "m3"))
def _(spark, sf_dir):
    return G.order_flow(ticks(spark, sf_dir)).select(*_COLS)


@query("sig_microstructure", _sig(_MICRO, "m4"))
def _(spark, sf_dir):
    return G.microstructure(ticks(spark, sf_dir)).select(*_COLS)


@query("sig_technical", _sig(_TECH, "m5"))
def _(spark, sf_dir):
    return G.technical(ticks(spark, sf_dir)).select(*_COLS)


def all_signals(spark, sf_dir):
    return G.all_kinds(ticks(spark, sf_dir)).select("symbol", "ts", "seq", "kind", "strength", "confidence")


_ALL = f"""{BASE}, {_MOM}, {_REV}, {_FLOW}, {_MICRO}, {_TECH}, sg AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4 UNION ALL SELECT * FROM m5)"""


@query(
    "sig_combine",
    f"""WITH {_ALL}, tm AS (SELECT DISTINCT symbol, ts FROM sg),
    p AS (SELECT a.symbol, a.ts, g.strength * pow(0.99995, (epoch_us(a.ts) - epoch_us(g.ts)) / CAST(1000000 AS DOUBLE)) AS s, g.confidence * pow(0.99995, (epoch_us(a.ts) - epoch_us(g.ts)) / CAST(1000000 AS DOUBLE)) AS k,
      CASE kind WHEN 'momentum' THEN 0.25 WHEN 'mean_reversion' THEN 0.2 WHEN 'order_flow' THEN 0.3 WHEN 'microstructure' THEN 0.15 ELSE 0.1 END AS w
      FROM tm a JOIN sg g ON g.symbol = a.symbol AND g.ts <= a.ts AND epoch_us(a.ts) - epoch_us(g.ts) < 36000000000)
    SELECT symbol, ts, count(*) AS components, round(sum(w * k), 6) AS total_weight, round(sum(s * w * k) / sum(w * k), 6) AS combined,
      round(max(k) * least(1, sum(w * k) / 0.5), 6) AS combined_confidence FROM p WHERE abs(s) > 0.1 AND k > 0.1 GROUP BY symbol, ts""",
)
def _(spark, sf_dir):
    """Ten hours in place of five seconds, as ticks of a symbol are hours apart here."""
    return G.combine(all_signals(spark, sf_dir), seconds=36_000, decay=0.99995, cell_seconds=86_400)


@query(
    "sig_performance",
    f"""WITH {_ALL} SELECT kind, count(*) AS signals, round(avg(strength), 6) AS mean_strength, round(avg(abs(strength)), 6) AS mean_size, round(avg(confidence), 6) AS mean_confidence,
      round(avg(CAST(abs(strength) > 0.1 AND confidence > 0.1 AS INT)), 6) AS acted_share FROM sg GROUP BY kind""",
)
def _(spark, sf_dir):
    """A signal counts as acted on if it is strong and sure enough to enter the combined signal."""
    acted = (F.abs("strength") > G.KEEP_ABOVE) & (F.col("confidence") > G.KEEP_ABOVE)
    return G.performance(all_signals(spark, sf_dir), acted)


@query(
    "sig_combine_methods",
    f"""WITH {_ALL} SELECT symbol, round(sum(strength * confidence) / sum(confidence), 6) AS weighted, round(median(strength), 6) AS median, round(arg_max(strength, (abs(strength), strength)), 6) AS strongest FROM sg GROUP BY symbol""",
)
def _(spark, sf_dir):
    g = all_signals(spark, sf_dir).withColumn("weight", F.col("confidence"))
    out = G.combine_values(g, ["symbol"]).withColumnRenamed("combined", "weighted")
    for method, name in (("median", "median"), ("max_abs", "strongest")):
        out = out.join(G.combine_values(g, ["symbol"], method).withColumnRenamed("combined", name), "symbol")
    return out


_CROSS = f"""x0 AS (SELECT *, avg(price) OVER {f(10)} AS short_ma, {roll('avg', 'price', 30)} AS long_ma FROM b), x1 AS (SELECT *, {lagged('short_ma', 1)} AS ps, {lagged('long_ma', 1)} AS pl FROM x0),
 xs AS (SELECT *, CASE WHEN ps <= pl AND short_ma > long_ma THEN 'buy' WHEN ps >= pl AND short_ma < long_ma THEN 'sell' END AS action FROM x1)"""


@query("sig_ma_cross", f"WITH {BASE}, {_CROSS} " + rounded("symbol seq action", "short_ma long_ma", "xs WHERE action IS NOT NULL"))
def _(spark, sf_dir):
    return G.ma_cross(ticks(spark, sf_dir)).select("symbol", "seq", "action", "short_ma", "long_ma")


_WT = "wt AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume WHEN side = 'ask' THEN -volume ELSE 0 END) AS weight FROM ticks GROUP BY symbol)"


@query(
    "sig_size_filter",
    f"""WITH {BASE}, {_CROSS}, {_WT}, z AS (SELECT x.*, least(floor(100000 * 0.02 / price), 1000) AS vol, weight * 10 AS held FROM xs x LEFT JOIN wt USING (symbol) WHERE action IS NOT NULL AND price > 0)
    SELECT symbol, seq, action, CAST(vol AS BIGINT) AS order_volume, round(CASE WHEN action = 'buy' THEN price - 0.01 ELSE price + 0.01 END, 6) AS limit_price FROM z WHERE abs(held + CASE WHEN action = 'buy' THEN vol ELSE -vol END) <= 3000""",
)
def _(spark, sf_dir):
    held = weights(spark, sf_dir).select("symbol", (F.col("weight") * 10).alias("qty"))
    out = G.size_filter(G.ma_cross(ticks(spark, sf_dir)), held, max_exposure=3000.0)
    return out.select("symbol", "seq", "action", "order_volume", "limit_price")


def _fair(spark, sf_dir):
    """Quotes with the VWAP of the last ten purchases known at their time."""
    t = ticks(spark, sf_dir)
    bought = windowed(
        t.filter("event_type = 'purchase'"),
        lambda d, w: d.withColumn(
            "vwap", F.try_divide(F.sum(F.col("price") * F.col("volume")).over(w.rowsBetween(-9, 0)), F.sum("volume").over(w.rowsBetween(-9, 0)))
        ),
        back=10,
    ).select("symbol", "ts", "seq", "vwap")
    return G.fair_value(J.asof_join(t.filter("event_type <> 'purchase'"), bought))


_FAIR = f"""pu AS (SELECT symbol, ts, seq, sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM ticks WHERE event_type = 'purchase' WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 fa AS (SELECT q.*, p.vwap, (q.bid * ask_volume + q.ask * bid_volume) / (bid_volume + ask_volume) AS micro FROM b q ASOF LEFT JOIN pu p ON q.symbol = p.symbol AND q.ts >= p.ts WHERE q.event_type <> 'purchase'),
 fv AS (SELECT *, (0.4 * mid + 0.5 * micro + coalesce(0.1 * vwap, 0)) / (0.9 + CASE WHEN vwap IS NULL THEN 0 ELSE 0.1 END) AS fair_value, CASE WHEN vwap IS NULL THEN 2 / CAST(3 AS DOUBLE) ELSE 1 END AS fair_value_confidence FROM fa)"""


@query("fair_value", f"WITH {BASE}, {_FAIR} " + rounded("symbol seq", "fair_value fair_value_confidence", "fv"))
def _(spark, sf_dir):
    return _fair(spark, sf_dir).select("symbol", "seq", "fair_value", "fair_value_confidence")


_PLAN = """q0 AS (SELECT *, (volume - 50) * 4 AS inventory, volume / 200 AS vol, volume > 80 AS adverse, greatest(0, 1 - spread / nullif(mid, 0) * 10000 / 20) AS pressure FROM fv),
 q1 AS (SELECT *, inventory / 1000 AS held, least(0.5, greatest(0.01, greatest(0.02, mid * 0.0001) * (1 + vol * 2) * (1 - coalesce(pressure, 0) * 0.3) * (1 + abs(inventory / 1000) * 0.5) * CASE WHEN adverse THEN 1.5 ELSE 1 END)) AS s FROM q0),
 q2 AS (SELECT *, greatest(least(fair_value - s / 2 - held * 0.1 * s / 2, bid - 0.01), bid - s * 2) AS qb, least(greatest(fair_value + s / 2 - held * 0.1 * s / 2, ask + 0.01), ask + s * 2) AS qa,
   greatest(0, least(greatest(least(floor(100 * (1 - held * 0.5)), least(500, floor(ask_volume / 2))), 1), 1000 - inventory)) AS bs,
   greatest(0, least(greatest(least(floor(100 * (1 + held * 0.5)), least(500, floor(bid_volume / 2))), 1), 1000 + inventory)) AS asz FROM q1)"""


@query(
    "quote_plan",
    f"WITH {BASE}, {_FAIR}, {_PLAN} " + rounded("symbol seq", "planned_spread bid_size ask_size bid_gap ask_gap", "(SELECT symbol, seq, s AS planned_spread, bs AS bid_size, asz AS ask_size, qb AS bid_gap, qa AS ask_gap FROM q2)", 5),
    digits=5,
)
def _(spark, sf_dir):
    """Prices are compared before rounding to the tick: a rounding step would turn the last bit into a cent."""
    d = _fair(spark, sf_dir).withColumns(
        {"inventory": (F.col("volume") - 50) * 4, "volatility": F.col("volume") / 200, "adverse": F.col("volume") > 80}
    )
    return G.quote_plan(d, tick=1e-9).select(
        "symbol", "seq", "planned_spread", "bid_size", "ask_size", F.col("quote_bid").alias("bid_gap"), F.col("quote_ask").alias("ask_gap")
    )


@query("adverse_selection", f"WITH {BASE} SELECT symbol, seq, coalesce(abs(price / {lagged('price', 2)} - 1) > 0.0005, FALSE) AS adverse FROM b")
def _(spark, sf_dir):
    return G.adverse_selection(ticks(spark, sf_dir)).select("symbol", "seq", "adverse")


_PAIR = f"""{TYPE_BARS}, pb AS (SELECT bar, a.price AS x, b.price AS y FROM kb a JOIN kb b USING (bar) WHERE a.symbol = 'view' AND b.symbol = 'click'),
 pz AS (SELECT *, count(*) OVER w AS n, avg(x) OVER w AS ma, avg(y) OVER w AS mb, regr_slope(x, y) OVER w AS h, var_pop(x) OVER w AS va, var_pop(y) OVER w AS vb, covar_pop(x, y) OVER w AS cab FROM pb WINDOW w AS (ORDER BY bar ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
 pq AS (SELECT bar, h AS hedge_ratio, x - h * y AS spread, ma - h * mb AS spread_mean, sqrt(greatest(va - 2 * h * cab + h * h * vb, 0)) AS spread_std FROM pz WHERE n >= 100)"""


@query(
    "pair_spread_z",
    f"""WITH {_PAIR}, z AS (SELECT *, (spread - spread_mean) / spread_std AS z FROM pq) """
    + rounded("bar action", "hedge_ratio spread spread_mean spread_std z", "(SELECT *, CASE WHEN abs(z) > 4 THEN 'stop' WHEN z > 2 THEN 'short_a_long_b' WHEN z < -2 THEN 'long_a_short_b' WHEN abs(z) < 0.5 THEN 'exit' END AS action FROM z)", 5),
    digits=5,
)
def _(spark, sf_dir):
    pair = J.equi_join_on_time(type_bars(spark, sf_dir), "view", "click").select(
        F.lit("view/click").alias("symbol"), "bar", F.col("value_a").alias("price_a"), F.col("value_b").alias("price_b")
    )
    out = G.pair_spread_z(pair, order=("bar",)).filter("hedge_ratio is not null")
    return out.select("bar", "action", "hedge_ratio", "spread", "spread_mean", "spread_std", "z")


@query(
    "pair_discovery",
    f"""WITH {DAY_BARS}, {PAIRS.format(t='db', op='<')}, st AS (SELECT a, b, n, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS corr, (sx - sy) / n AS m,
      sqrt(((sxx - sx * sx / n) + (syy - sy * sy / n) - 2 * (sxy - sx * sy / n)) / (n - 1)) AS sd FROM pm WHERE n >= 12),
    lt AS (SELECT x.symbol AS a, y.symbol AS b, arg_max(x.price - y.price, x.bar) AS s FROM db x JOIN db y ON x.bar = y.bar AND x.symbol < y.symbol GROUP BY ALL)
    SELECT a, b, n, round(corr, 5) AS corr, round((s - m) / sd, 5) AS z, round(abs((s - m) / sd) * sd, 4) AS expected_profit, round(least(abs((s - m) / sd) / 1.5, 1), 5) AS confidence
    FROM st JOIN lt USING (a, b) WHERE abs(corr) > 0.4 AND abs((s - m) / sd) > 1.5""".replace(", 4) AS expected", ", 5) AS expected"),
    digits=5,
)
def _(spark, sf_dir):
    """Looser thresholds than the defaults, so that the unrelated test series give rows."""
    out = G.pair_discovery(day_bars(spark, sf_dir), min_corr=0.4, min_z=1.5, least=12)
    return out.select("a", "b", "n", "corr", "z", "expected_profit", "confidence")


_VEN = f"{TICKS}, mn AS (SELECT symbol, ts, price AS primary_price FROM ticks WHERE event_type = 'view'), vj AS (SELECT o.symbol, o.seq, o.event_type AS venue, o.price, primary_price FROM (SELECT * FROM ticks WHERE event_type <> 'view') o ASOF LEFT JOIN mn ON o.symbol = mn.symbol AND o.ts >= mn.ts)"


@query(
    "cross_venue_arb",
    f"WITH {_VEN} " + rounded("symbol seq buy_venue sell_venue", "buy_price sell_price spread_pct profit_per_10k", """(SELECT symbol, seq, CASE WHEN price > primary_price THEN 'primary' ELSE venue END AS buy_venue, CASE WHEN price > primary_price THEN venue ELSE 'primary' END AS sell_venue,
    least(price, primary_price) AS buy_price, greatest(price, primary_price) AS sell_price, abs(price - primary_price) / primary_price AS spread_pct, abs(price - primary_price) / primary_price * 10000 AS profit_per_10k FROM vj) WHERE spread_pct > 0.005""", 4),
    digits=4,
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir).select("symbol", "ts", "seq", F.col("event_type").alias("venue"), "price")
    return G.cross_venue_arb(J.venue_join(t, "view")).select(
        "symbol", "seq", "buy_venue", "sell_venue", "buy_price", "sell_price", "spread_pct", "profit_per_10k"
    )


_POOLS = """pl AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, s_name AS venue, p_retailprice * (1 + (s_suppkey % 7 - 3) / CAST(100 AS DOUBLE)) AS venue_price, greatest(s_acctbal, 0) * 500 AS liquidity, p_retailprice
  FROM part JOIN supplier ON s_suppkey % 20 = p_partkey % 20)"""


def pools(spark, sf_dir):
    """Suppliers as venues: each part trades on those with the same number modulo 20.

    A part meets a twentieth of all suppliers, so parts are spread over all cores
    first, and what is of one side is computed once for each of its rows.
    """
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), "p_retailprice", (F.col("p_partkey") % 20).alias("_part"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("venue"), (1 + (F.col("s_suppkey") % 7 - 3) / 100).alias("_off"), (F.greatest("s_acctbal", F.lit(0.0)) * 500).alias("liquidity"),
        (F.col("s_suppkey") % 20).alias("_supplier"),
    )
    p = p.repartition(4 * spark.sparkContext.defaultParallelism, "symbol")
    return p.join(broadcast_if_small(s), F.col("_part") == F.col("_supplier")).select(
        "symbol", "venue", (F.col("p_retailprice") * F.col("_off")).alias("venue_price"), "liquidity", "p_retailprice"
    )


@query(
    "best_route",
    f"""WITH {_POOLS}, od AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS symbol, l_quantity AS volume, CAST(l_partkey AS VARCHAR) || '/' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS order_key FROM lineitem),
    op AS (SELECT od.*, p_retailprice AS pp FROM od JOIN part ON CAST(p_partkey AS VARCHAR) = symbol),
    c AS (SELECT order_key, 'primary' AS venue, pp * (1 + 0.001 + least(0.01, volume / 100000)) AS cost FROM op UNION ALL
      SELECT order_key, venue, venue_price * (1 + least(0.5, volume * pp / (2 * liquidity))) + 5 FROM op JOIN pl USING (symbol) WHERE liquidity > 0 AND least(0.5, volume * pp / (2 * liquidity)) <= 0.01)
    SELECT order_key, arg_min(venue, (cost, venue)) AS venue, round(min(cost), 4) AS cost FROM c GROUP BY order_key""",
    digits=4,
)
def _(spark, sf_dir):
    whole = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("primary_price"))
    orders = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol"), F.col("l_quantity").alias("volume"), whole.alias("order_key")
    ).distinct().join(p, "symbol")
    # Read off the files' statistics, where the orders would have to be computed.
    below_zero = not (table(spark, sf_dir, "lineitem").filter("l_quantity < 0").isEmpty() and table(spark, sf_dir, "part").filter("p_retailprice < 0").isEmpty())
    return G.best_route(orders, pools(spark, sf_dir), below_zero=below_zero).select("order_key", "venue", "cost")


@query(
    "venue_fair_value",
    f"""WITH {_POOLS}, v AS (SELECT symbol, sum(venue_price * liquidity) / nullif(sum(liquidity), 0) AS vv, sum(liquidity) AS l FROM pl GROUP BY symbol)
    SELECT CAST(p_partkey AS VARCHAR) AS symbol, round(coalesce(p_retailprice * 0.7 + vv * 0.3, p_retailprice), 5) AS fair_value,
    round(CASE WHEN l > 0 THEN least(1, 1 / (1 + log10(l))) ELSE 1 END, 5) AS liquidity_risk FROM part LEFT JOIN v ON symbol = CAST(p_partkey AS VARCHAR)""",
    digits=5,
)
def _(spark, sf_dir):
    main = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("primary_price"))
    return G.venue_fair_value(pools(spark, sf_dir), main)


def contracts(spark, sf_dir):
    """Order lines as option contracts on the part: strike around the trade price, expiry by tax, side by status."""
    t = trades(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_retailprice").alias("spot"), F.col("p_brand").alias("book"))
    return t.join(p, "symbol").select(
        "symbol", "order_id", "line_no", "book", "spot", (F.col("spot") * (F.lit(0.9) + F.col("volume") / 250)).alias("strike"),
        (F.col("tax") * 10).alias("years"), F.lit(0.03).alias("rate"), (F.col("discount") + 0.1).alias("volatility"),
        F.when(F.col("side") == "bid", "call").otherwise("put").alias("kind"), F.when(F.col("flag") == "R", -1.0).otherwise(1.0).alias("quantity"),
        (F.col("price") / F.col("spot") - 1).alias("move"),
    )


def _cdf(x: str) -> str:
    """Normal distribution function as its power series, x**(2n+1) / (1*3*...*(2n+1)) times the density."""
    term = f"exp((2 * n + 1) * ln(abs({x})) - ((n + 1) * ln(2) + lgamma(n + 1.5) - 0.5 * ln(pi())))"
    total = f"list_sum(list_transform(range(0, 120), lambda n: {term}))"
    return f"0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * CASE WHEN {x} = 0 THEN 0 ELSE {total} END"


_CHAIN = f"""{TRADES}, oc0 AS (SELECT symbol, p_brand AS book, p_retailprice AS s, p_retailprice * (0.9 + volume / 250) AS k, tax * 10 AS t, CAST(0.03 AS DOUBLE) AS r, discount + 0.1 AS v, side = 'bid' AS call,
    CASE WHEN flag = 'R' THEN -1 ELSE 1 END AS q, price / p_retailprice - 1 AS move FROM trades JOIN part ON CAST(p_partkey AS VARCHAR) = symbol),
  oc1 AS (SELECT *, CASE WHEN t > 0 THEN (ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t)) END AS d1 FROM oc0),
  oc2 AS (SELECT *, d1 - v * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM oc1),
  oc3 AS (SELECT *, {_cdf('d1')} AS n1, {_cdf('d2')} AS n2, exp(-r * t) AS disc FROM oc2),
  oc AS (SELECT *, CASE WHEN t > 0 THEN greatest(0, CASE WHEN call THEN s * n1 - k * disc * n2 ELSE k * disc * (1 - n2) - s * (1 - n1) END) ELSE greatest(0, CASE WHEN call THEN s - k ELSE k - s END) END AS val,
    CASE WHEN t > 0 THEN CASE WHEN call THEN n1 ELSE n1 - 1 END ELSE 0 END AS delta, CASE WHEN t > 0 THEN pdf / (s * v * sqrt(t)) ELSE 0 END AS gamma,
    CASE WHEN t > 0 THEN (-(s * pdf * v) / (2 * sqrt(t)) + CASE WHEN call THEN -r * k * disc * n2 ELSE r * k * disc * (1 - n2) END) / 365 ELSE 0 END AS theta,
    CASE WHEN t > 0 THEN s * pdf * sqrt(t) / 100 ELSE 0 END AS vega, CASE WHEN t > 0 THEN CASE WHEN call THEN k * t * disc * n2 ELSE -k * t * disc * (1 - n2) END / 100 ELSE 0 END AS rho FROM oc3)"""


@query(
    "option_chain_greeks",
    f"WITH {_CHAIN} " + rounded("book", "delta gamma theta vega rho value", "(SELECT book, sum(delta * q * 100) AS delta, sum(gamma * q * 100) AS gamma, sum(theta * q * 100) AS theta, sum(vega * q * 100) AS vega, sum(rho * q * 100) AS rho, sum(val * q * 100) AS value FROM oc GROUP BY book)", 4),
    digits=4,
)
def _(spark, sf_dir):
    """Per book.  Single contracts are checked in tests/test_values.py."""
    return O.book_greeks(O.position_greeks(O.price_chain(contracts(spark, sf_dir))))


@query("delta_hedge", f"WITH {_CHAIN} SELECT symbol, round(-sum(delta * q * 100), 5) AS hedge_quantity, round(sum(0.5 * gamma * move * move * q), 5) AS gamma_pnl FROM oc GROUP BY symbol", digits=5)
def _(spark, sf_dir):
    return O.delta_hedge(O.position_greeks(O.price_chain(contracts(spark, sf_dir))))


@query(
    "option_intrinsic",
    f"""WITH {TRADES} SELECT symbol, count(*) AS contracts, round(sum(CASE WHEN side = 'bid' THEN greatest(0, p_retailprice - p_retailprice * (0.9 + volume / 250)) ELSE greatest(0, p_retailprice * (0.9 + volume / 250) - p_retailprice) END), 3) AS intrinsic
    FROM trades JOIN part ON CAST(p_partkey AS VARCHAR) = symbol GROUP BY symbol""",
    digits=3,
)
def _(spark, sf_dir):
    return O.price_chain(contracts(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("contracts"), F.sum("intrinsic_value").alias("intrinsic"))
