"""Order books and joins."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import BOOK_LEVELS, TICKS, TRADES, query, rounded
from tickloom.operators import bars as B
from tickloom.operators import books as K
from tickloom.operators import joins as J
from tickloom.plans.merging import overlap_lots
from tickloom.plans.pairs import pair_moments
from tickloom.sources.standins import BOOK_TIE, TRADE_ORDER, book_levels, table, ticks, trades

_SNAP = ", ".join(
    f"max(CASE WHEN side = '{s}' AND level = {i} THEN {v} END) AS {s}_{v}_{i}" for s in ("bid", "ask") for i in (1, 2, 3) for v in ("price", "volume")
)


@query(
    "book_snapshot",
    f"""WITH {BOOK_LEVELS}, s AS (SELECT symbol, ts, {_SNAP}, sum(CASE WHEN side = 'bid' THEN volume ELSE 0 END) AS total_bid_volume,
    sum(CASE WHEN side = 'ask' THEN volume ELSE 0 END) AS total_ask_volume FROM rk WHERE level <= 3 GROUP BY symbol, ts)
    SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid_price, ask_price_1 - bid_price_1 AS spread FROM s""",
)
def _(spark, sf_dir):
    return K.snapshots(book_levels(spark, sf_dir), depth=3, tie=BOOK_TIE)


_TOP = f"""{BOOK_LEVELS}, q AS (SELECT symbol, ts, max(CASE WHEN side = 'bid' AND level = 1 THEN price END) AS bb, max(CASE WHEN side = 'bid' AND level = 1 THEN volume END) AS bv,
  max(CASE WHEN side = 'ask' AND level = 1 THEN price END) AS ba, max(CASE WHEN side = 'ask' AND level = 1 THEN volume END) AS av,
  sum(CASE WHEN side = 'bid' THEN volume ELSE 0 END) AS tb, sum(CASE WHEN side = 'ask' THEN volume ELSE 0 END) AS ta FROM rk WHERE level <= 20 GROUP BY symbol, ts)"""


@query(
    "quote_metrics",
    f"WITH {_TOP} " + rounded(
        "symbol ts is_crossed is_locked", "best_bid best_bid_volume best_ask best_ask_volume total_bid_volume total_ask_volume mid_price spread spread_bps imbalance",
        """(SELECT symbol, ts, coalesce(bb >= ba, FALSE) AS is_crossed, coalesce(abs(bb - ba) < 1e-8, FALSE) AS is_locked, bb AS best_bid, bv AS best_bid_volume, ba AS best_ask,
        av AS best_ask_volume, tb AS total_bid_volume, ta AS total_ask_volume, (bb + ba) / 2 AS mid_price, ba - bb AS spread, (ba - bb) / ((bb + ba) / 2) * 10000 AS spread_bps,
        (tb - ta) / nullif(tb + ta, 0) AS imbalance FROM q)""",
    ),
)
def _(spark, sf_dir):
    return K.quote_metrics(K.to_books(book_levels(spark, sf_dir), 20, tie=BOOK_TIE)).drop("bids", "asks")


@query(
    "best_quote_ffill",
    f"""WITH {BOOK_LEVELS}, b AS (SELECT symbol, ts, max(CASE WHEN side = 'bid' THEN price END) AS b, min(CASE WHEN side = 'ask' THEN price END) AS a FROM lv GROUP BY symbol, ts),
    f AS (SELECT symbol, ts, last_value(b IGNORE NULLS) OVER w AS bb, last_value(a IGNORE NULLS) OVER w AS ba FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) """
    + rounded("symbol ts order_id line_no", "price best_bid best_ask mid_price spread spread_pct spread_ticks price_vs_mid price_vs_mid_pct",
    """(SELECT l.symbol, l.ts, order_id, line_no, price, bb AS best_bid, ba AS best_ask, (bb + ba) / 2 AS mid_price, ba - bb AS spread, (ba - bb) / ((bb + ba) / 2) * 100 AS spread_pct,
    (ba - bb) / 0.01 AS spread_ticks, price - (bb + ba) / 2 AS price_vs_mid, (price - (bb + ba) / 2) / ((bb + ba) / 2) * 100 AS price_vs_mid_pct FROM lv l JOIN f ON f.symbol = l.symbol AND f.ts = l.ts)""", 5),
    digits=5,
)
def _(spark, sf_dir):
    out = K.best_quote_ffill(book_levels(spark, sf_dir))
    return out.select("symbol", "ts", "order_id", "line_no", "price", "best_bid", "best_ask", "mid_price", "spread", "spread_pct",
                      "spread_ticks", "price_vs_mid", "price_vs_mid_pct")


@query("depth_levels", f"WITH {BOOK_LEVELS} SELECT symbol, ts, level, price, volume FROM rk WHERE side = 'ask' AND level <= 3")
def _(spark, sf_dir):
    return K.depth_levels(K.to_books(book_levels(spark, sf_dir), 20, tie=BOOK_TIE), "asks", 3)


@query("volume_at_price", f"WITH {BOOK_LEVELS} SELECT symbol, ts, side, sum(CASE WHEN price = 1500 + CAST(symbol AS INT) THEN volume ELSE 0 END) AS volume FROM lv GROUP BY symbol, ts, side")
def _(spark, sf_dir):
    return K.volume_at_price(book_levels(spark, sf_dir), F.lit(1500.0) + F.col("symbol").cast("int"))


@query(
    "market_impact",
    f"""WITH {BOOK_LEVELS}, c AS (SELECT *, sum(volume) OVER (PARTITION BY symbol, ts, side ORDER BY level) - volume AS prev FROM rk),
    t AS (SELECT symbol, ts, side, sum(least(volume, greatest(60 - prev, 0)) * price) AS cost, sum(least(volume, greatest(60 - prev, 0))) AS took, arg_max(price, level) AS last FROM c GROUP BY symbol, ts, side)
    SELECT symbol, ts, side, round((cost + (60 - took) * last) / 60, 6) AS average_price, round(cost + (60 - took) * last, 6) AS total_cost FROM t""",
)
def _(spark, sf_dir):
    return K.market_impact(book_levels(spark, sf_dir), F.lit(60.0), tie=BOOK_TIE)


@query(
    "microprice",
    f"WITH {_TOP} SELECT symbol, ts, round((ba * bv + bb * av) / (bv + av), 6) AS microprice, round((0.5 * ba * bv + 0.5 * bb * av) / (bv + av), 6) AS halved FROM q",
)
def _(spark, sf_dir):
    q = K.quote_metrics(K.to_books(book_levels(spark, sf_dir), 20, tie=BOOK_TIE))
    return q.select("symbol", "ts", K.microprice().alias("microprice"), K.microprice(0.5).alias("halved"))


_PQ = f"{TICKS}, tr AS (SELECT * FROM ticks WHERE event_type = 'purchase'), qt AS (SELECT * FROM ticks WHERE event_type <> 'purchase')"


def _trades_quotes(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.filter("event_type = 'purchase'"), t.filter("event_type <> 'purchase'")


@query(
    "effective_spread",
    f"WITH {_PQ} SELECT t.symbol, t.seq, round((q.bid + q.ask) / 2, 6) AS mid_price, round(2 * abs(t.price - (q.bid + q.ask) / 2), 6) AS effective_spread FROM tr t ASOF LEFT JOIN qt q ON t.symbol = q.symbol AND t.ts >= q.ts",
)
def _(spark, sf_dir):
    return K.effective_spread(*_trades_quotes(spark, sf_dir)).select("symbol", "seq", "mid_price", "effective_spread")


@query(
    "asof_join",
    f"WITH {_PQ} SELECT t.symbol, t.seq, round(t.price, 6) AS price, round(q.bid, 6) AS bid, round(q.ask, 6) AS ask FROM tr t ASOF LEFT JOIN qt q ON t.symbol = q.symbol AND t.ts >= q.ts",
)
def _(spark, sf_dir):
    t, q = _trades_quotes(spark, sf_dir)
    return J.asof_join(t.select("symbol", "ts", "seq", "price"), q, take=["bid", "ask"]).drop("ts")


_DELTAS = f"{TICKS}, dl AS (SELECT symbol, ts, seq, coalesce(side, 'bid') AS side, floor(price / 5) AS price, CASE WHEN volume < 30 THEN 0 ELSE volume END AS qty FROM ticks)"


def depth_deltas(spark, sf_dir):
    return ticks(spark, sf_dir).select(
        "symbol", "ts", "seq", F.coalesce("side", F.lit("bid")).alias("side"), F.floor(F.col("price") / 5).cast("double").alias("price"),
        F.when(F.col("volume") < 30, F.lit(0.0)).otherwise(F.col("volume")).alias("qty"),
    )


@query(
    "l2_state",
    f"""WITH {_DELTAS}, l AS (SELECT symbol, side, price, arg_max(qty, seq) AS volume FROM dl WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY symbol, side, price),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM l WHERE volume > 0)
    SELECT symbol, side, price, volume, level FROM r WHERE level <= 20""",
)
def _(spark, sf_dir):
    return K.l2_state(depth_deltas(spark, sf_dir), 20, until=F.lit("2024-01-20").cast("timestamp"))


_L3 = f"""{BOOK_LEVELS}, u AS (SELECT *, row_number() OVER (PARTITION BY order_id * 10 + line_no ORDER BY ts DESC, part DESC, volume DESC, price DESC, discount DESC, tax DESC, flag DESC, side DESC) AS rn FROM lv)"""


def order_updates(spark, sf_dir):
    """Order lines as updates of the order (order, line); returned lines cancel."""
    return book_levels(spark, sf_dir).withColumns(
        {"order_id": F.col("order_id") * 10 + F.col("line_no"), "action": F.when(F.col("flag") == "R", "cancel").otherwise("new")}
    )


@query("l3_book_from_updates", f"WITH {_L3} SELECT symbol, side, price, sum(volume) AS volume, count(*) AS orders FROM u WHERE rn = 1 AND flag <> 'R' GROUP BY symbol, side, price")
def _(spark, sf_dir):
    return K.l3_levels(order_updates(spark, sf_dir), order=("ts", "part", "volume", "price", "discount", "tax", "flag", "side"))


@query(
    "book_ladder",
    f"""WITH {BOOK_LEVELS}, m AS (SELECT symbol, ts, (max(CASE WHEN side = 'bid' AND level = 1 THEN price END) + max(CASE WHEN side = 'ask' AND level = 1 THEN price END)) / 2 AS mid_price FROM rk GROUP BY symbol, ts)
    SELECT r.symbol, r.ts, r.side, r.level, r.price, r.volume, m.mid_price, r.price - m.mid_price AS distance FROM rk r JOIN m ON m.symbol = r.symbol AND m.ts = r.ts WHERE r.level <= 5""",
)
def _(spark, sf_dir):
    return K.ladder(book_levels(spark, sf_dir), 5, tie=BOOK_TIE).select("symbol", "ts", "side", "level", "price", "volume", "mid_price", "distance")


_BOTH = ", ".join(
    f"({x} FILTER (side = 'bid' AND {v} IS NOT NULL)) AS b{t}_{v}, ({y} FILTER (side = 'ask' AND {v} IS NOT NULL)) AS a{t}_{v}"
    for v, o in (("va", "oa"), ("vb", "ob"))
    for t, x, y in (("p", "max(price)", "min(price)"), ("v", f"arg_max({v}, price)", f"arg_min({v}, price)"), ("n", "count(*)", "count(*)"))
)


@query(
    "book_diff",
    f"""WITH {BOOK_LEVELS}, x AS (SELECT symbol, side, price, sum(volume) AS va, count(*) AS oa FROM lv WHERE flag <> 'R' GROUP BY ALL),
    y AS (SELECT symbol, side, price, sum(volume) AS vb, count(*) AS ob FROM lv WHERE flag <> 'A' GROUP BY ALL),
    j AS (SELECT symbol, side, price, va, oa, vb, ob FROM x FULL JOIN y USING (symbol, side, price)),
    g AS (SELECT symbol, {_BOTH}, sum(oa) AS oa, sum(ob) AS ob FROM j GROUP BY symbol),
    h AS (SELECT symbol, abs(coalesce(bp_va, 0) - coalesce(bp_vb, 0)) < 1e-8 AS best_bid_match, abs(coalesce(ap_va, 0) - coalesce(ap_vb, 0)) < 1e-8 AS best_ask_match,
      bv_va IS NOT DISTINCT FROM bv_vb AS bid_volume_match, av_va IS NOT DISTINCT FROM av_vb AS ask_volume_match, oa IS NOT DISTINCT FROM ob AS order_count_match,
      bn_va = bn_vb AS bid_levels_match, an_va = an_vb AS ask_levels_match FROM g)
    SELECT *, best_bid_match AND best_ask_match AND bid_volume_match AND ask_volume_match AND order_count_match AND bid_levels_match AND ask_levels_match AS identical FROM h""",
)
def _(spark, sf_dir):
    """The book without returned lines against the book without accepted ones, per supplier."""
    lv = book_levels(spark, sf_dir)

    def levels(df):
        return df.groupBy("symbol", "side", "price").agg(F.sum("volume").alias("volume"), F.count("*").alias("orders"))

    return K.diff(levels(lv.filter("flag <> 'R'")), levels(lv.filter("flag <> 'A'")))


@query(
    "book_stats",
    f"""WITH {BOOK_LEVELS} SELECT symbol, ts, count(*) FILTER (side = 'bid') AS bid_levels, count(*) FILTER (side = 'ask') AS ask_levels,
    sum(CASE WHEN side = 'bid' THEN volume ELSE 0 END) AS total_bid_volume, sum(CASE WHEN side = 'ask' THEN volume ELSE 0 END) AS total_ask_volume, count(*) AS orders,
    coalesce(max(CASE WHEN side = 'bid' THEN price END) >= min(CASE WHEN side = 'ask' THEN price END), FALSE) AS is_crossed,
    max(CASE WHEN side = 'bid' THEN price END) IS NULL OR min(CASE WHEN side = 'ask' THEN price END) IS NULL AS is_empty_side FROM lv GROUP BY symbol, ts""",
)
def _(spark, sf_dir):
    return K.book_stats(book_levels(spark, sf_dir))


@query(
    "quote_history",
    f"WITH {TICKS} SELECT symbol, seq, rank, round(price, 6) AS price, round(ask - bid, 6) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rank FROM ticks) WHERE rank <= 20",
)
def _(spark, sf_dir):
    return K.recent(ticks(spark, sf_dir), 20).select("symbol", "seq", "rank", "price", (F.col("ask") - F.col("bid")).alias("spread"))


TYPE_BARS = f"{TICKS}, kb AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, avg(price) AS price FROM ticks GROUP BY ALL)"


def type_bars(spark, sf_dir):
    """Hourly mean price per event type: five long series."""
    return ticks(spark, sf_dir).groupBy(F.col("event_type").alias("symbol"), B.bin_start("ts", 3600).alias("bar")).agg(F.avg("price").alias("price"))


DAY_BARS = f"{TICKS}, db AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS bar, avg(price) AS price FROM ticks GROUP BY ALL)"


def day_bars(spark, sf_dir):
    """Daily mean price per symbol: many short series."""
    return ticks(spark, sf_dir).groupBy("symbol", B.bin_start("ts", 86_400).alias("bar")).agg(F.avg("price").alias("price"))


@query("equi_join_on_time", f"WITH {TYPE_BARS} SELECT bar, round(a.price, 6) AS value_a, round(b.price, 6) AS value_b FROM kb a JOIN kb b USING (bar) WHERE a.symbol = 'view' AND b.symbol = 'click'")
def _(spark, sf_dir):
    return J.equi_join_on_time(type_bars(spark, sf_dir), "view", "click")


PAIRS = """pm AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, sum(x.price) AS sx, sum(y.price) AS sy, sum(x.price * x.price) AS sxx,
  sum(y.price * y.price) AS syy, sum(x.price * y.price) AS sxy FROM {t} x JOIN {t} y ON x.bar = y.bar AND x.symbol {op} y.symbol GROUP BY ALL)"""


@query("self_join_pairs", f"WITH {DAY_BARS}, {PAIRS.format(t='db', op='<')} " + rounded("a b n", "sx sy sxx syy sxy", "pm", 2), digits=2)
def _(spark, sf_dir):
    return pair_moments(day_bars(spark, sf_dir))


_LOTS = f"""{TRADES}, s AS (SELECT *, sum(CASE WHEN side = 'bid' THEN volume ELSE 0 END) OVER w AS cb, sum(CASE WHEN side = 'ask' THEN volume ELSE 0 END) OVER w AS cs,
  sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) OVER w AS pos FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY {', '.join(TRADE_ORDER)} ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT *, cs + least(0, min(pos) OVER (PARTITION BY symbol ORDER BY {', '.join(TRADE_ORDER)} ROWS UNBOUNDED PRECEDING)) AS matched FROM s),
  sl AS (SELECT *, coalesce(lag(matched) OVER (PARTITION BY symbol ORDER BY {', '.join(TRADE_ORDER)}), 0) AS before FROM m)"""
_FIFO = f"""{_LOTS},
  ov AS (SELECT k.symbol, k.ts AS sell_ts, k.order_id AS sell_order, k.line_no AS sell_line, k.volume AS sell_volume, k.price AS sell_price, b.order_id AS buy_order, b.price AS buy_price,
    least(k.matched, b.cb) - greatest(k.before, b.cb - b.volume) AS overlap FROM sl k JOIN s b ON b.symbol = k.symbol AND b.side = 'bid' AND b.cb > k.before AND b.cb - b.volume < k.matched
    WHERE k.side = 'ask' AND k.matched > k.before)"""


# The axis of matched quantity cut at all ends: each piece lies in one sell and one buy, so no pairs are compared.
_OVERLAPS = f"""{_LOTS}
  , se AS (SELECT symbol, before AS lo, matched AS hi, order_id, price FROM sl WHERE side = 'ask' AND matched > before),
  bu AS (SELECT symbol, cb - volume AS lo, cb AS hi, order_id, price FROM s WHERE side = 'bid' AND volume > 0),
  pt AS (SELECT symbol, lo AS p FROM se UNION SELECT symbol, hi FROM se UNION SELECT symbol, lo FROM bu UNION SELECT symbol, hi FROM bu),
  iv AS (SELECT symbol, p, lead(p) OVER (PARTITION BY symbol ORDER BY p) AS q FROM pt),
  i1 AS (SELECT iv.symbol, p, q, se.lo AS sell_lo, se.order_id AS sell_order, se.price AS sell_price FROM iv ASOF JOIN se ON iv.symbol = se.symbol AND iv.p >= se.lo WHERE iv.q <= se.hi),
  i2 AS (SELECT i1.*, bu.lo AS buy_lo, bu.hi AS buy_hi, bu.order_id AS buy_order, bu.price AS buy_price FROM i1 ASOF JOIN bu ON i1.symbol = bu.symbol AND i1.p >= bu.lo)"""


@query(
    "interval_overlap_join",
    f"""WITH {_OVERLAPS} SELECT symbol, sell_order, buy_order, round(sum(q - p), 4) AS overlap, round(max(sell_price), 4) AS sell_price, round(max(buy_price), 4) AS buy_price
    FROM i2 WHERE q <= buy_hi GROUP BY symbol, sell_lo, buy_lo, sell_order, buy_order""",
    digits=4,
)
def _(spark, sf_dir):
    from tickloom.operators.pnl import fifo_lots

    buys, sells = fifo_lots(trades(spark, sf_dir), order=TRADE_ORDER)
    lot = ("symbol", "order_id", "price", "hi")
    met = overlap_lots(sells.select(*lot), buys.select(*lot))
    return met.select(
        "symbol", F.col("left.order_id").alias("sell_order"), F.col("right.order_id").alias("buy_order"), "overlap",
        F.col("left.price").alias("sell_price"), F.col("right.price").alias("buy_price"),
    )


POSITIONS = f"""{TRADES}, ps AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN volume ELSE -volume END) AS qty, max(price) AS top FROM trades GROUP BY symbol)"""


def net_positions(spark, sf_dir):
    signed = F.when(F.col("side") == "bid", F.col("volume")).otherwise(-F.col("volume"))
    return trades(spark, sf_dir).groupBy("symbol").agg(F.sum(signed).alias("qty"), F.max("price").alias("top"))


def scenarios(spark, sf_dir):
    """Regions as scenarios, nations as the asset group they shock."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("r_name").alias("scenario"), F.col("n_nationkey").cast("long").alias("grp"), ((F.col("n_nationkey") - 12) / 100).alias("shock")
    )


@query(
    "scenario_join",
    f"""WITH {POSITIONS}, sc AS (SELECT r_name AS scenario, n_nationkey AS grp, (n_nationkey - 12) / CAST(100 AS DOUBLE) AS shock FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT symbol, scenario, round(qty * top * shock, 4) AS pnl FROM ps JOIN sc ON CAST(symbol AS BIGINT) % 25 = grp""",
    digits=4,
)
def _(spark, sf_dir):
    pos = net_positions(spark, sf_dir).select(
        "symbol", (F.col("symbol").cast("long") % 25).alias("grp"), (F.col("qty") * F.col("top")).alias("market_value")
    )
    return J.scenario_join(pos, scenarios(spark, sf_dir), on="grp").select("symbol", "scenario", "pnl")


def limits(spark, sf_dir):
    own = table(spark, sf_dir, "part").filter("p_size > 40").select(
        F.lit("position_limit").alias("limit_type"), F.col("p_partkey").cast("string").alias("symbol"), (F.col("p_size") * 3.0).alias("limit_value")
    )
    everyone = spark.createDataFrame([("position_limit", None, 200.0)], "limit_type string, symbol string, limit_value double")
    return own.unionByName(everyone)


LIMITS = "lm AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_size * CAST(3 AS DOUBLE) AS own FROM part WHERE p_size > 40)"


@query(
    "limit_join",
    f"WITH {POSITIONS}, {LIMITS} SELECT ps.symbol, qty, coalesce(own, 200) AS limit_value, own IS NOT NULL AS has_own_limit, abs(qty) > coalesce(own, 200) AS breached FROM ps LEFT JOIN lm USING (symbol)",
)
def _(spark, sf_dir):
    out = J.limit_join(net_positions(spark, sf_dir), limits(spark, sf_dir), "position_limit")
    return out.select("symbol", "qty", "limit_value", "has_own_limit", (F.abs("qty") > F.col("limit_value")).alias("breached"))


@query(
    "mark_join",
    f"""WITH {POSITIONS}, mk AS (SELECT symbol, arg_max(price, ({', '.join(TRADE_ORDER)})) AS mark_price FROM trades GROUP BY symbol)
    SELECT symbol, qty, round(mark_price, 4) AS mark_price FROM ps LEFT JOIN mk USING (symbol)""",
    digits=4,
)
def _(spark, sf_dir):
    marks = J.latest_marks(trades(spark, sf_dir), order=TRADE_ORDER)
    return J.mark_join(net_positions(spark, sf_dir), marks).select("symbol", "qty", "mark_price")


@query(
    "venue_join",
    f"""WITH {TICKS}, mn AS (SELECT symbol, ts, price AS primary_price FROM ticks WHERE event_type = 'view'), ot AS (SELECT * FROM ticks WHERE event_type <> 'view')
    SELECT o.symbol, o.seq, o.event_type AS venue, round(o.price, 6) AS price, round(primary_price, 6) AS primary_price FROM ot o ASOF LEFT JOIN mn ON o.symbol = mn.symbol AND o.ts >= mn.ts""",
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir).select("symbol", "ts", "seq", F.col("event_type").alias("venue"), "price")
    return J.venue_join(t, "view").drop("ts")


@query(
    "routing_join",
    "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'default') AS broker, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL",
)
def _(spark, sf_dir):
    routes = table(spark, sf_dir, "part").filter("p_size > 10").select(
        F.col("p_partkey").cast("string").alias("symbol"), F.col("p_brand").alias("broker")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("symbol"))
    return J.routing_join(lines, routes, "default").groupBy("l_orderkey", "l_linenumber", "broker").agg(F.count("*").alias("n"))


@query(
    "own_trade_semi_join",
    """WITH own AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT l_orderkey AS buy_order_id, l_partkey AS sell_order_id, l_linenumber, l_quantity,
      l_orderkey IN (SELECT o_orderkey FROM own) OR l_partkey IN (SELECT o_orderkey FROM own) AS mine FROM lineitem)
    SELECT buy_order_id, sell_order_id, CAST(mine AS BOOLEAN) AS mine, count(*) AS n, sum(l_quantity) AS volume FROM t GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Lines as trades between the order and (for the test) the order numbered like the part."""
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("buy_order_id"), F.col("l_partkey").alias("sell_order_id"), "l_quantity"
    )
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"))
    return J.own_trades(t, own, mark="mine").groupBy("buy_order_id", "sell_order_id", "mine").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("volume"))
