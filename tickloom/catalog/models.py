"""Event log, scaling, models, user surface."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import TICKS, W, query, rounded
from tickloom.catalog.risk import AVG_COST, MARKS, POS, marks, positions
from tickloom.operators import eventlog as E
from tickloom.operators import features as X
from tickloom.operators import models as M
from tickloom.operators import pnl as P
from tickloom.operators import usersurface as U
from tickloom.plans.shuffling import permuted_place_sql
from tickloom.sources import files
from tickloom.sources.standins import table, ticks

_LINE_SORT = "ts, l_partkey, l_linenumber, quantity, price, l_discount, l_tax"
_LOG = f"""ev AS (
  SELECT o_orderkey AS order_id, 'order_created' AS event_type, o_orderdate AS ts, CAST(o_custkey % 200 + 20 AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS price,
    CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_custkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 0 AS step, 0 AS l_partkey, 0 AS l_linenumber, 0 AS l_discount, 0 AS l_tax FROM orders
  UNION ALL SELECT l_orderkey, 'order_filled', l_shipdate, l_quantity, l_extendedprice / l_quantity, NULL, NULL, 1, l_partkey, l_linenumber, l_discount, l_tax FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT o_orderkey, 'order_cancelled', TIMESTAMP '2000-06-01', 0, 0, NULL, NULL, 2, 0, 0, 0, 0 FROM orders WHERE o_orderstatus = 'P'),
lg AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY CASE WHEN step = 0 THEN 0 ELSE 1 END, {_LINE_SORT}, step) AS version FROM ev)"""


def order_log(spark, sf_dir):
    """Orders as created, their lines as fills, orders of status P cancelled on a fixed day."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    zero = [F.lit(0).cast("long").alias(c) for c in ("l_partkey", "l_linenumber")] + [F.lit(0.0).alias(c) for c in ("l_discount", "l_tax")]
    no = [F.lit(None).cast("string").alias(c) for c in ("symbol", "side")]
    made = o.select(
        F.col("o_orderkey").alias("order_id"), F.lit(E.CREATED).alias("event_type"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        (F.col("o_custkey") % 200 + 20).cast("double").alias("quantity"), F.lit(0.0).alias("price"), F.col("o_custkey").cast("string").alias("symbol"),
        F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(0).alias("step"), *zero,
    )
    fills = li.join(o.select("o_orderkey"), li["l_orderkey"] == o["o_orderkey"], "left_semi").select(
        F.col("l_orderkey").alias("order_id"), F.lit(E.FILLED).alias("event_type"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), *no, F.lit(1).alias("step"),
        "l_partkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_discount", "l_tax",
    )
    gone = o.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("order_id"), F.lit(E.CANCELLED).alias("event_type"), F.lit("2000-06-01").cast("timestamp").alias("ts"),
        F.lit(0.0).alias("quantity"), F.lit(0.0).alias("price"), *no, F.lit(2).alias("step"), *zero,
    )
    log = made.unionByName(fills).unionByName(gone).withColumns(
        {"aggregate_id": F.col("order_id").cast("string"), "_late": (F.col("step") > 0).cast("int")}
    )
    order = ("_late", "ts", "l_partkey", "l_linenumber", "quantity", "price", "l_discount", "l_tax", "step")
    return E.versioned(log, order).drop("_late")


@query("ev_by_aggregate", f"WITH {_LOG} SELECT version, event_type, ts, quantity FROM lg WHERE order_id = 77 AND version BETWEEN 1 AND 5")
def _(spark, sf_dir):
    return E.by_aggregate(order_log(spark, sf_dir), "77", 1, 5).select("version", "event_type", "ts", "quantity")


@query("ev_by_type_time", f"WITH {_LOG} SELECT order_id, ts, quantity FROM lg WHERE event_type = 'order_filled' AND ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def _(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp")
    return E.by_type_time(order_log(spark, sf_dir), E.FILLED, day("1997-01-01"), day("1997-06-30")).select("order_id", "ts", "quantity")


@query("ev_append", f"WITH {_LOG} SELECT order_id, event_type, version, round(quantity, 3) AS quantity FROM lg", digits=3)
def _(spark, sf_dir):
    path = files.derived_path(spark, "order-log")
    log = order_log(spark, sf_dir).select("order_id", "aggregate_id", "event_type", "ts", "version", "quantity")
    E.append(log, path, span="year")  # few events a day here
    return spark.read.parquet(path).select("order_id", "event_type", "version", "quantity")


_STATE = f"""{_LOG}, st AS (SELECT order_id, max(CASE WHEN event_type = 'order_created' THEN symbol END) AS symbol, max(CASE WHEN event_type = 'order_created' THEN side END) AS side,
  max(CASE WHEN event_type = 'order_created' THEN quantity END) AS quantity, sum(CASE WHEN event_type = 'order_filled' THEN quantity ELSE 0 END) AS filled,
  count(*) FILTER (event_type = 'order_cancelled') AS cancels, max(version) AS version FROM lg GROUP BY order_id),
os AS (SELECT order_id, symbol, side, quantity, filled, greatest(quantity - filled, 0) AS remaining, CASE WHEN cancels > 0 THEN 'cancelled' WHEN filled >= quantity THEN 'filled' WHEN filled > 0 THEN 'partial' ELSE 'new' END AS status, version FROM st)"""


@query("ev_order_state", f"WITH {_STATE} SELECT * FROM os")
def _(spark, sf_dir):
    return E.order_state(order_log(spark, sf_dir))


@query("ev_orders_by_symbol", f"WITH {_STATE} SELECT * FROM os WHERE symbol = '42' AND status = 'filled'")
def _(spark, sf_dir):
    return E.orders_by_symbol(E.order_state(order_log(spark, sf_dir)), "42", "filled")


_MARKED = f"""{AVG_COST}, {POS}, {MARKS}, pm AS (SELECT symbol, qty, avg_price, qty * mark_price AS market_value, (mark_price - avg_price) * qty AS unrealized_pnl, realized_pnl FROM po JOIN mk USING (symbol))"""


def marked(spark, sf_dir):
    out = P.mark_to_market(positions(spark, sf_dir), marks(spark, sf_dir))
    return out.select("symbol", "qty", "avg_price", "market_value", "unrealized_pnl", "realized_pnl")


@query(
    "ev_position_state",
    f"WITH RECURSIVE {_MARKED} " + rounded("symbol", "qty avg_price market_value unrealized_pnl realized_pnl", """(SELECT r.symbol, coalesce(qty, 0) AS qty, coalesce(avg_price, 0) AS avg_price, coalesce(market_value, 0) AS market_value,
    coalesce(unrealized_pnl, 0) AS unrealized_pnl, coalesce(realized_pnl, 0) AS realized_pnl FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS symbol FROM orders) r LEFT JOIN pm USING (symbol))""", 3),
    digits=3,
)
def _(spark, sf_dir):
    """Customers' numbers are requested as symbols; some have no position."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"))
    return E.position_state(asked, marked(spark, sf_dir))


@query(
    "ev_portfolio_pnl",
    f"WITH RECURSIVE {_MARKED} " + rounded("strategy open_positions", "market_value unrealized_pnl realized_pnl total_pnl", """(SELECT p_brand AS strategy, count(*) FILTER (qty <> 0) AS open_positions, sum(market_value) AS market_value,
    sum(unrealized_pnl) AS unrealized_pnl, sum(realized_pnl) AS realized_pnl, sum(unrealized_pnl + realized_pnl) AS total_pnl FROM pm JOIN part ON CAST(p_partkey AS VARCHAR) = symbol GROUP BY p_brand)""", 2),
    digits=2,
)
def _(spark, sf_dir):
    owner = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_brand").alias("strategy"))
    return E.portfolio_pnl(marked(spark, sf_dir).join(owner, "symbol"))


@query(
    "ev_illegal_transitions",
    f"""WITH {_LOG}, r AS (SELECT *, max(CASE WHEN event_type = 'order_created' THEN quantity END) OVER w AS ordered, sum(CASE WHEN event_type = 'order_filled' THEN quantity ELSE 0 END) OVER w AS done,
      count(CASE WHEN event_type = 'order_cancelled' THEN 1 END) OVER w AS cancels FROM lg WINDOW w AS (PARTITION BY order_id ORDER BY version ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, coalesce(lag(done >= ordered OR cancels > 0) OVER (PARTITION BY order_id ORDER BY version), FALSE) AS was FROM r),
    x AS (SELECT order_id, version, event_type, CASE WHEN was AND event_type <> 'order_created' THEN 'after_terminal' WHEN event_type = 'order_filled' AND done > ordered THEN 'overfill' END AS fault FROM l)
    SELECT * FROM x WHERE fault IS NOT NULL""",
)
def _(spark, sf_dir):
    return E.illegal_transitions(order_log(spark, sf_dir)).select("order_id", "version", "event_type", "fault")


@query(
    "ev_exec_summary",
    """WITH d AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS filled, sum(l_extendedprice) AS val, count(*) AS executions, sum(l_discount) AS commission, sum(l_tax) AS fees FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS order_id, CAST(o_custkey % 200 + 20 AS DOUBLE) AS quantity, coalesce(filled, 0) AS filled, coalesce(executions, 0) AS executions, greatest(o_custkey % 200 + 20 - coalesce(filled, 0), 0) AS remaining,
      coalesce(filled, 0) >= o_custkey % 200 + 20 AS complete, round(coalesce(filled, 0) / (o_custkey % 200 + 20) * 100, 5) AS fill_pct, round(val / filled, 5) AS avg_fill_price,
      round(coalesce(commission, 0), 5) AS commission, round(coalesce(fees, 0), 5) AS fees FROM orders LEFT JOIN d ON order_id = o_orderkey""",
    digits=5,
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 200 + 20).cast("double").alias("quantity"))
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_discount").alias("commission"), F.col("l_tax").alias("fees"),
    )
    return E.execution_summary(o, x)


@query(
    "normalise_features",
    f"""WITH {TICKS}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS sd, min(price) AS lo, max(price) - min(price) AS wd, median(price) AS med FROM ticks), d AS (SELECT median(abs(price - med)) AS mad FROM ticks, s)
    SELECT seq, round((price - m) / sd, 6) AS z, round((price - lo) / wd, 6) AS mm, round((price - med) / mad, 6) AS rb FROM ticks, s, d""",
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir).select("seq", "price")
    out = M.normalise_features(t, "zscore", ["seq"]).withColumnRenamed("price", "z")
    for method, name in (("minmax", "mm"), ("mad", "rb")):
        out = out.join(M.normalise_features(t, method, ["seq"]).withColumnRenamed("price", name), "seq")
    return out


@query(
    "robust_scale",
    f"""WITH {TICKS}, s AS (SELECT median(price) AS pm, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS pi, median(volume) AS vm, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS vi FROM ticks WHERE ts < TIMESTAMP '2024-01-20')
    SELECT seq, round((price - pm) / pi, 6) AS price, round((volume - vm) / vi, 6) AS volume FROM ticks, s""",
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir)
    fitted = M.fit_scaling(t.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")), ["price", "volume"], "iqr")
    return M.apply_scaling(t.select("seq", "price", "volume"), fitted, ["price", "volume"])


_POSN = f"{TICKS}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)"


@query(
    "time_series_split",
    f"""WITH {_POSN}, x AS (SELECT seq, fold, n - (3 - fold) * (n // 4) AS st, n // 4 AS sz, pos FROM n, (SELECT unnest([0, 1, 2]) AS fold))
    SELECT seq, fold, CASE WHEN pos < st THEN 'train' ELSE 'test' END AS part FROM x WHERE pos < st + sz""",
)
def _(spark, sf_dir):
    return M.time_series_split(ticks(spark, sf_dir)).select("seq", "fold", "part")


@query(
    "walk_forward",
    f"""WITH {TICKS}, n AS (SELECT event_type AS symbol, price, row_number() OVER (PARTITION BY event_type ORDER BY ts, seq) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM ticks),
    p AS (SELECT symbol, unnest(generate_series(0, (n - 315) // 63)) AS period FROM (SELECT DISTINCT symbol, n FROM n WHERE n >= 315)),
    x AS (SELECT n.symbol, period, CASE WHEN pos < period * 63 + 252 THEN 'train' ELSE 'test' END AS part, price FROM n JOIN p ON p.symbol = n.symbol AND pos >= period * 63 AND pos < period * 63 + 315)
    SELECT symbol, period, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows, round(avg(price) FILTER (part = 'train'), 6) AS train_mean, round(avg(price) FILTER (part = 'test'), 6) AS test_mean FROM x GROUP BY symbol, period""",
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("symbol", F.col("event_type"))
    return M.period_summary(M.walk_forward(t), "price")


_FEATURES = ("price_sma_ratio_10", "rsi_14", "volume_ratio_10", "returns_5")


def labelled(spark, sf_dir):
    """Ratios and strengths per event-type series with the direction and size of the next move."""
    t = ticks(spark, sf_dir).withColumn("symbol", F.col("event_type"))
    out = X.forward_label(X.compute(t, list(_FEATURES)), horizon=5)
    return out.dropna(subset=list(_FEATURES))


@query("fit_direction")
def _(spark, sf_dir):
    """Accuracy per fold of the forest."""
    tagged = M.time_series_split(labelled(spark, sf_dir))
    return M.fold_scores(tagged, M.fit_direction, _FEATURES, "direction", True)


@query("fit_magnitude")
def _(spark, sf_dir):
    """Squared error per fold of the boosted trees."""
    tagged = M.time_series_split(labelled(spark, sf_dir))
    return M.fold_scores(tagged, M.fit_magnitude, _FEATURES, "magnitude", False)


_PRED = f"""{TICKS}, pr AS (SELECT symbol, seq, price - 50 AS y, {{lag1}} - 50 AS m1, {{avg5}} - 50 AS m2 FROM ticks), pp AS (SELECT * FROM pr WHERE m1 IS NOT NULL)""".format(
    lag1=f"lag(price) OVER ({W})", avg5=f"avg(price) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
)


def predictions(spark, sf_dir):
    """Two simple forecasts of the price: the last one, and the mean of the last five."""
    lag1 = X.Feature("m1", lambda w: F.lag("price").over(w) - 50, back=1)
    avg5 = X.Feature("m2", lambda w: F.avg("price").over(w.rowsBetween(-5, -1)) - 50, back=5)
    out = X.compute(ticks(spark, sf_dir), [lag1, avg5]).filter("m1 is not null")
    return out.select("symbol", F.col("seq").alias("row_id"), (F.col("price") - 50).alias("y"), "m1", "m2")


@query(
    "regression_metrics",
    f"""WITH {_PRED} SELECT symbol, round(avg((y - m1) * (y - m1)), 5) AS mse, round(avg(abs(y - m1)), 5) AS mae, round(sqrt(avg((y - m1) * (y - m1))), 5) AS rmse,
    round(1 - sum((y - m1) * (y - m1)) / nullif(var_pop(y) * count(y), 0), 5) AS r2, round(avg(CAST(sign(y) = sign(m1) AS INT)), 5) AS direction_accuracy FROM pp GROUP BY symbol""",
    digits=5,
)
def _(spark, sf_dir):
    return M.regression_metrics(predictions(spark, sf_dir), "y", "m1", keys=("symbol",))


@query(
    "sequence_windows",
    f"""WITH {TICKS}, w AS (SELECT symbol, seq, ts, price, list(price) OVER x AS p, list(volume) OVER x AS v, count(*) OVER x AS c FROM ticks WINDOW x AS ({W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM w WHERE c = 8)
    SELECT symbol, seq, round(price, 6) AS target, round(p[1], 6) AS first_price, round(v[8], 6) AS last_volume, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM k""",
)
def _(spark, sf_dir):
    out = M.sequence_windows(ticks(spark, sf_dir), ["price", "volume"], 8, "price")
    return out.select("symbol", "seq", "target", F.col("window")[0][0].alias("first_price"), F.col("window")[7][1].alias("last_volume"), "part")


def _long(spark, sf_dir):
    return predictions(spark, sf_dir).unpivot(["row_id", "y"], ["m1", "m2"], "model", "yhat")


_EW = f"""{_PRED}, lw AS (SELECT 'm1' AS model, 1 / (avg(abs(y - m1)) + 1e-8) AS inv FROM pp UNION ALL SELECT 'm2', 1 / (avg(abs(y - m2)) + 1e-8) FROM pp),
 l2 AS (SELECT model, greatest(inv / (SELECT sum(inv) FROM lw), 0.01) AS w FROM lw), ew AS (SELECT model, w / (SELECT sum(w) FROM l2) AS weight FROM l2)"""


@query("ensemble_weights", f"WITH {_EW} SELECT model, round(weight, 6) AS weight FROM ew")
def _(spark, sf_dir):
    return M.ensemble_weights(_long(spark, sf_dir).withColumn("error", F.col("y") - F.col("yhat")))


@query(
    "ensemble_combine",
    f"WITH {_EW} SELECT seq AS row_id, round((m1 + m2) / 2, 6) AS mean, round(m1 * (SELECT weight FROM ew WHERE model = 'm1') + m2 * (SELECT weight FROM ew WHERE model = 'm2'), 6) AS weighted FROM pp",
)
def _(spark, sf_dir):
    p = _long(spark, sf_dir)
    return M.ensemble_combine(p, M.ensemble_weights(p.withColumn("error", F.col("y") - F.col("yhat"))))


@query(
    "ensemble_stacking",
    f"""WITH {_PRED}, s AS (SELECT var_pop(m1) AS v1, var_pop(m2) AS v2, covar_pop(m1, m2) AS c12, covar_pop(m1, y) AS c1, covar_pop(m2, y) AS c2, avg(m1) AS a1, avg(m2) AS a2, avg(y) AS ay FROM pp),
    k AS (SELECT (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2, a1, a2, ay FROM s)
    SELECT 'm1' AS name, round(b1, 5) AS coefficient FROM k UNION ALL SELECT 'm2', round(b2, 5) FROM k UNION ALL SELECT 'intercept', round(ay - b1 * a1 - b2 * a2, 5) FROM k""",
    digits=5,
)
def _(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return M.ensemble_stacking(_long(spark, sf_dir), p.select("row_id", "y"), ["m1", "m2"])


@query(
    "importance_by_category",
    f"""WITH {TICKS}, c AS (SELECT 'price' AS feature, avg(abs(price - 50)) AS i FROM ticks UNION ALL SELECT 'volume', avg(abs(volume - 50)) FROM ticks UNION ALL SELECT 'bid_volume', avg(abs(bid_volume - 50)) FROM ticks)
    SELECT CASE feature WHEN 'price' THEN 'price' ELSE 'size' END AS category, round(sum(i), 6) AS importance, count(*) AS features FROM c GROUP BY 1""",
)
def _(spark, sf_dir):
    cols = ["price", "volume", "bid_volume"]
    long = ticks(spark, sf_dir).select(*[(F.col(c) - 50).alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    return M.importance_by_category(long, M.category_map(spark, {"price": "price", "volume": "size", "bid_volume": "size"}))


@query(
    "permutation_importance",
    f"""WITH {_PRED}, r AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM pp), z AS (SELECT count(*) AS n FROM r),
    p AS (SELECT m1, m2, {permuted_place_sql('i', 'n', '42')} AS p1, {permuted_place_sql('i', 'n', '43')} AS p2 FROM r, z),
    s AS (SELECT avg(pow(r.y - (r.m1 + r.m2) / 2, 2)) AS base, avg(pow(r.y - (a.m1 + r.m2) / 2, 2)) AS s1, avg(pow(r.y - (r.m1 + b.m2) / 2, 2)) AS s2 FROM r JOIN p a ON a.p1 = r.i JOIN p b ON b.p2 = r.i)
    SELECT 'm1' AS feature, round(s1 - base, 5) AS importance FROM s UNION ALL SELECT 'm2', round(s2 - base, 5) FROM s""",
    digits=5,
)
def _(spark, sf_dir):
    """Rise of the squared error of (m1 + m2) / 2 when one of them is shuffled."""
    score = F.avg(F.pow(F.col("y") - (F.col("m1") + F.col("m2")) / 2, 2))
    return M.permutation_importance(predictions(spark, sf_dir), ["m1", "m2"], score)


@query(
    "anomaly_distance",
    f"""WITH {TICKS}, s AS (SELECT avg(price) AS mp, avg(volume) AS mv, var_samp(price) AS vp, var_samp(volume) AS vv, covar_samp(price, volume) AS c FROM ticks),
    d AS (SELECT seq, (vv * (price - mp) * (price - mp) - 2 * c * (price - mp) * (volume - mv) + vp * (volume - mv) * (volume - mv)) / (vp * vv - c * c) AS distance FROM ticks, s)
    SELECT seq, round(distance, 5) AS distance, distance > (SELECT quantile_cont(distance, 0.9) FROM d) AS is_anomaly FROM d""",
    digits=5,
)
def _(spark, sf_dir):
    return M.anomaly_distance(ticks(spark, sf_dir), ["price", "volume"]).select("seq", "distance", "is_anomaly")


@query("robust_distance")
def _(spark, sf_dir):
    """Prices and volumes by robust distance; tests hold it against a plain program and planted outliers."""
    return M.robust_distance(ticks(spark, sf_dir), ["price", "volume", "bid_volume"]).select("seq", "distance", "is_anomaly")


@query(
    "regime_change",
    f"""WITH {TICKS}, x AS (SELECT symbol, seq, avg(price) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS r, avg(price) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING) AS e FROM ticks)
    SELECT symbol, seq, round(r, 6) AS recent_mean, round(e, 6) AS earlier_mean, coalesce(r > 2 * e, FALSE) AS regime_change FROM x""",
)
def _(spark, sf_dir):
    return M.regime_change(ticks(spark, sf_dir), "price").select("symbol", "seq", "recent_mean", "earlier_mean", "regime_change")


@query(
    "row_l2_normalise",
    """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), n AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS norm FROM x GROUP BY vec_id)
    SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(v AS DOUBLE) / norm, 6) AS v FROM x JOIN n USING (vec_id)""",
)
def _(spark, sf_dir):
    out = M.l2_normalise(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), "v")


@query("udf_filter", f"WITH {TICKS} SELECT seq, round(price, 6) AS price FROM ticks WHERE sqrt(price) % 2 < 1")
def _(spark, sf_dir):
    return U.udf_filter(ticks(spark, sf_dir), "price", lambda p: (p**0.5) % 2 < 1).select("seq", "price")


@query("udf_chunk", f"WITH {TICKS} SELECT seq, round(price * 2, 6) AS twice FROM ticks WHERE volume > 10")
def _(spark, sf_dir):
    def fn(pdf):
        keep = pdf[pdf["volume"] > 10]
        return keep.assign(twice=keep["price"] * 2)[["seq", "twice"]]

    return U.chunk_map(ticks(spark, sf_dir).select("seq", "price", "volume"), fn, "seq bigint, twice double")


@query("udf_feature", f"WITH {TICKS} SELECT seq, round(price / (1 + volume), 6) AS per_size FROM ticks")
def _(spark, sf_dir):
    return U.udf_feature(ticks(spark, sf_dir), "per_size", ["price", "volume"], lambda price, volume: price / (1 + volume)).select("seq", "per_size")


@query(
    "udtf_stream_function",
    f"WITH {TICKS} SELECT seq, 'tick' AS kind, round(price, 6) AS amount FROM ticks UNION ALL SELECT seq, 'large', round(price * volume, 6) FROM ticks WHERE volume > 80",
)
def _(spark, sf_dir):
    @F.udtf(returnType="kind string, amount double")
    class Split:
        """A tick, and a second event for a large one."""

        def eval(self, price: float, volume: float):
            yield "tick", price
            if volume > 80:
                yield "large", price * volume

    return U.event_function(ticks(spark, sf_dir), Split, "price", "volume").select("seq", "kind", "amount")
