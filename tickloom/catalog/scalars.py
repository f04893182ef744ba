"""Scalars, standardisation, filters and de-duplication."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import TICKS, TRADES, W, query, rounded
from tickloom.functions import checks as C
from tickloom.functions import scalars as S
from tickloom.operators import cleaning
from tickloom.plans.series import windowed
from tickloom.sources import files
from tickloom.sources.standins import table, ticks, trades


@query("column_alias_resolution", f"WITH {TICKS} " + rounded("ts symbol order_id", "price volume", "(SELECT ts, symbol, seq AS order_id, price, volume FROM ticks)"))
def _(spark, sf_dir):
    """Foreign column names; price is found by inference only."""
    odd = ticks(spark, sf_dir).select(
        F.col("ts").alias("DateTime"), F.col("symbol").alias("Instrument"), F.col("seq").alias("ID"),
        F.col("price").alias("reading"), F.col("volume").alias("Qty"),
    )
    return files.resolve_columns(odd, infer=True).select(
        F.col("timestamp").alias("ts"), "symbol", "order_id", "price", "volume"
    )


@query(
    "default_columns",
    "SELECT user_id AS symbol_id, event_id, TIMESTAMP '2024-01-01 09:30:00' + to_seconds(event_id) AS ts, CAST(100.0 AS DOUBLE) AS price, CAST(100 AS DOUBLE) AS volume FROM events",
)
def _(spark, sf_dir):
    src = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol_id"), F.col("event_id").alias("row_no"))
    return files.resolve_columns(src, row_index=F.col("row_no")).select(
        F.col("symbol_id").cast("long").alias("symbol_id"), F.col("row_no").alias("event_id"),
        F.col("timestamp").alias("ts"), "price", "volume",
    )


@query(
    "numeric_coerce",
    "SELECT event_id, round(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), 6) AS v FROM events",
)
def _(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.to_number(text).alias("v"))


@query(
    "timestamp_parse",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('click', 'signup') THEN ts ELSE date_trunc('second', ts) END AS ts FROM events""",
)
def _(spark, sf_dir):
    k, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    text = (
        F.when(k == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(k == "signup", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == "view", F.date_format(ts, "yyyyMMdd HH:mm:ss"))
        .when(k == "purchase", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise("soon")
    )
    return table(spark, sf_dir, "events").select("event_id", S.parse_time(text).alias("ts"))


@query(
    "epoch_unit_detect",
    """SELECT event_id, CASE event_type WHEN 'click' THEN ts WHEN 'view' THEN ts
       WHEN 'signup' THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END AS ts FROM events""",
)
def _(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_type")
    raw = (
        F.when(k == "click", us).when(k == "view", us * 1000)
        .when(k == "signup", F.floor(us / 1000)).otherwise(F.floor(us / 1_000_000))
    )
    return table(spark, sf_dir, "events").select("event_id", S.epoch_time(raw).alias("ts"))


@query(
    "timestamp_interpolate",
    """WITH b AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(ts) END AS us FROM events),
    f AS (SELECT event_id, us, last_value(us IGNORE NULLS) OVER p AS lo, last_value(CASE WHEN us IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS lo_id,
      first_value(us IGNORE NULLS) OVER n AS hi, first_value(CASE WHEN us IS NOT NULL THEN event_id END IGNORE NULLS) OVER n AS hi_id
      FROM b WINDOW p AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, CASE WHEN us IS NOT NULL THEN us WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo
      ELSE CAST(floor(lo + CAST(hi - lo AS DOUBLE) * (event_id - lo_id) / (hi_id - lo_id)) AS BIGINT) END AS us FROM f""",
)
def _(spark, sf_dir):
    """Times of error rows removed, then blended from the neighbours by row position."""
    src = table(spark, sf_dir, "events").select(
        F.lit("log").alias("series"), "event_id", F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")).alias("ts")
    )
    return cleaning.interpolate_time(src, ts="ts", keys=("series",), order="event_id").select(
        "event_id", F.unix_micros("ts").alias("us")
    )


@query("side_normalise", "SELECT event_id, CASE event_type WHEN 'click' THEN 'bid' WHEN 'purchase' THEN 'bid' WHEN 'view' THEN 'ask' WHEN 'signup' THEN 'ask' ELSE 'hold' END AS side FROM events")
def _(spark, sf_dir):
    k = F.col("event_type")
    raw = F.when(k == "click", "B").when(k == "purchase", "1").when(k == "view", "Sell").when(k == "signup", "2").otherwise("HOLD")
    return table(spark, sf_dir, "events").select("event_id", S.side_code(raw).alias("side"))


@query("order_type_normalise", "SELECT event_id, CASE event_type WHEN 'click' THEN 'market' WHEN 'purchase' THEN 'limit' WHEN 'view' THEN 'cancel' ELSE event_type END AS order_type FROM events")
def _(spark, sf_dir):
    k = F.col("event_type")
    raw = F.when(k == "click", "MKT").when(k == "purchase", "L").when(k == "view", "Cnl").otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", S.order_type_code(raw).alias("order_type"))


@query("narrow_types", "SELECT event_id AS order_id, round(value, 6) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        S.to_number(F.col("event_id").cast("string"), "long").alias("order_id"),
        S.to_number(F.col("value").cast("string")).alias("price"),
        S.to_number(F.get_json_object("props", "$.k"), "long").alias("volume"),
    )


@query("symbol_normalise", "SELECT event_id, upper(event_type) || 'USD' AS symbol FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.symbol_code(F.concat("event_type", F.lit("/usd"))).alias("symbol"))


@query("round_to_tick", "SELECT event_id, round(round_even(value / 0.25, 0) * 0.25, 6) AS price FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.round_to_tick("value", 0.25).alias("price"))


@query(
    "price_level",
    f"WITH {TICKS} SELECT symbol, seq, CAST(trunc((price - min(price) OVER (PARTITION BY symbol)) / 0.01 + 1e-9) AS BIGINT) AS level FROM ticks",
)
def _(spark, sf_dir):
    return cleaning.price_level(ticks(spark, sf_dir), tick=0.01).select("symbol", "seq", "level")


@query("safe_divide", f"WITH {TICKS} SELECT symbol, seq, round(CASE WHEN abs(volume) < 1e-10 THEN 0.0 ELSE price / volume END, 6) AS r FROM ticks")
def _(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", "seq", S.safe_divide("price", "volume").alias("r"))


@query("returns", f"WITH {TICKS} " + rounded("symbol seq", "simple log_ret", f"(SELECT symbol, seq, price / lag(price) OVER w - 1 AS simple, ln(price / lag(price) OVER w) AS log_ret FROM ticks WINDOW w AS ({W}))"))
def _(spark, sf_dir):
    def add(df, w):
        prev = F.lag("price").over(w)
        return df.withColumns({"simple": S.quotient("price", prev) - 1, "log_ret": S.log_quotient("price", prev)})

    return windowed(ticks(spark, sf_dir), add, back=1).select("symbol", "seq", "simple", "log_ret")


@query(
    "micros_and_format",
    """SELECT event_id, epoch_us(ts) AS us, make_timestamp(epoch_us(ts)) AS back, printf('%.2f', value) AS price,
       format('{:,}', CAST(floor(value * 1000) AS BIGINT)) AS volume,
       CASE WHEN value - 50 >= 0 THEN '+' ELSE '' END || printf('%.2f', value - 50) AS pnl,
       printf('%.2f', value / 500 * 100) || '%' AS pct,
       CASE WHEN value * 100 + 1.37 >= 1000 THEN printf('%.1f', (value * 100 + 1.37) / 1000) || 'K' ELSE printf('%.1f', value * 100 + 1.37) END AS big FROM events
       WHERE event_id >= 0""",
)
def _(spark, sf_dir):
    v = F.col("value")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", us.alias("us"), F.timestamp_micros(us).alias("back"), S.format_price(v).alias("price"),
        S.format_volume(F.floor(v * 1000)).alias("volume"), S.format_pnl(v - 50).alias("pnl"),
        S.format_percent(v / 500).alias("pct"), S.format_large(v * 100 + 1.37).alias("big"),
    )


@query(
    "symbol_price_qty_check",
    """SELECT p_partkey, regexp_full_match(upper(split_part(p_name, ' ', 1)), '[A-Z][A-Z0-9]{0,12}') AS good_symbol,
       regexp_full_match(p_brand, '[A-Z][A-Z0-9]{0,12}') AS good_brand, p_retailprice - 1000 > 0 AS good_price,
       (p_size > 0 AND p_size = floor(p_size)) AS good_size FROM part""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.valid_symbol(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("good_symbol"),
        S.valid_symbol("p_brand").alias("good_brand"), S.valid_price(F.col("p_retailprice") - 1000).alias("good_price"),
        S.valid_quantity("p_size").alias("good_size"),
    )


@query("sanitise", "SELECT p_partkey, trim(replace(p_name, ' ', '')) AS cell, upper(p_brand) AS brand, list_transform(string_split(p_name, ' '), lambda x: trim(x)) AS words FROM part")
def _(spark, sf_dir):
    dirty = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit(",")), F.lit(" "))
    payload = S.trim_map(F.create_map(F.lit("brand"), F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" "))))
    words = F.transform(F.split("p_name", " "), lambda x: F.concat(F.lit(" "), x))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.clean_cell(dirty).alias("cell"), payload["brand"].alias("brand"), S.trim_array(words).alias("words")
    )


@query(
    "signal_normalise",
    "SELECT event_id, round(tanh((value - 50) / 50), 6) AS th, round(greatest(-1, least(1, (value - 50) / 50)), 6) AS cl, round(2 / (1 + exp(-(value - 50) / 50)) - 1, 6) AS sg FROM events",
)
def _(spark, sf_dir):
    x = (F.col("value") - 50) / 50
    return table(spark, sf_dir, "events").select(
        "event_id", S.squash(x).alias("th"), S.squash(x, "clip").alias("cl"), S.squash(x, "sigmoid").alias("sg")
    )


@query(
    "time_parts",
    """SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, epoch_us(ts) % 1000000 AS microsecond,
       isodow(ts) - 1 AS day_of_week, CAST(hour(ts) = 9 AND minute(ts) >= 30 AS INT) AS is_market_open,
       CAST(hour(ts) = 16 AND minute(ts) = 0 AS INT) AS is_market_close, CAST(hour(ts) = 12 AS INT) AS is_lunch_time,
       round((epoch_us(ts) - epoch_us(date_trunc('day', ts)) - 34200000000) / CAST(60000000 AS DOUBLE), 6) AS minutes_since_open FROM events""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in S.time_parts("ts").items()])


@query("session_flags", "SELECT event_id, CAST(hour(ts) BETWEEN 9 AND 15 AS INT) AS is_open, CAST(hour(ts) = 12 AS INT) AS is_lunch FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in S.session_flags("ts").items()])


@query(
    "is_tradeable",
    """SELECT e.event_id, (n.n_nationkey % 5 <> 0) AND hour(e.ts) >= 6 + n.n_nationkey % 4 AND hour(e.ts) < 18 AS tradeable
       FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25""",
)
def _(spark, sf_dir):
    """Nations play the venues: every fifth is halted, opening hours differ."""
    assets = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("asset"),
        F.when(F.col("n_nationkey") % 5 != 0, "trading").otherwise("halted").alias("status"),
        (6 + F.col("n_nationkey") % 4).alias("open_hour"), F.lit(18).alias("close_hour"),
    )
    src = table(spark, sf_dir, "events").withColumn("asset", F.col("user_id") % 25)
    return cleaning.tradeable(src, assets, keys=("asset",)).select("event_id", "tradeable")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS packed FROM events")
def _(spark, sf_dir):
    data = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", data["k"].alias("k"), F.to_json(data).alias("packed"))


@query(
    "message_encode_validate",
    f"""WITH {TICKS} SELECT seq, bid > 0 AS quote_ok, side IS NOT NULL AND volume > 0 AS order_ok, side IS NOT NULL AND volume > 0 AS exec_ok,
        TRUE AS position_ok, round((ask + bid) / 2, 6) AS mid FROM ticks""",
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumns({
        "way": F.when(F.col("side") == "bid", "buy").when(F.col("side") == "ask", "sell"),
        "order_type": F.lit("limit"), "status": F.lit("new"), "commission": F.lit(0.0), "position": F.col("volume"),
        "unrealized_pnl": F.lit(0.0), "realized_pnl": F.lit(0.0),
    })
    quote = C.encode_market_data()
    return t.select(
        "seq", C.valid_message(quote).alias("quote_ok"),
        C.valid_message(C.encode_order_event("seq", side="way", quantity="volume")).alias("order_ok"),
        C.valid_message(C.encode_execution("seq", "seq", side="way", quantity="volume")).alias("exec_ok"),
        C.valid_message(C.encode_position(average_price="price")).alias("position_ok"),
        F.get_json_object(quote, "$.mid_price").cast("double").alias("mid"),
    )


@query("clean_rows", f"WITH {TICKS} " + rounded("symbol seq ts", "price volume", "ticks WHERE price BETWEEN 0.0001 AND 1000000 AND volume BETWEEN 1 AND 1000000 AND ts IS NOT NULL"))
def _(spark, sf_dir):
    return ticks(spark, sf_dir).filter(C.clean_row()).select("symbol", "seq", "ts", "price", "volume")


@query("clean_rows_fast", f"WITH {TICKS} " + rounded("symbol seq ts", "price volume", "ticks WHERE price > 0 AND price < 1e6 AND volume > 0 AND volume < 1e9"))
def _(spark, sf_dir):
    return ticks(spark, sf_dir).filter(C.clean_row_fast()).select("symbol", "seq", "ts", "price", "volume")


@query(
    "dedup_keep_last",
    f"WITH {TRADES} " + rounded("symbol ts order_id", "price volume", """(SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY order_id DESC, line_no DESC,
      volume DESC, price DESC, discount DESC, tax DESC, flag DESC, supplier DESC) AS rn FROM trades) WHERE rn = 1""", 4),
    digits=4,
)
def _(spark, sf_dir):
    df = cleaning.keep_last(
        trades(spark, sf_dir), keys=("symbol", "ts"),
        tie=("order_id", "line_no", "volume", "price", "discount", "tax", "flag", "supplier"),
    )
    return df.select("symbol", "ts", "order_id", "price", "volume")


@query("filter_spec", f"WITH {TICKS} " + rounded("symbol seq event_type", "price", "ticks WHERE price BETWEEN 10 AND 200 AND event_type IN ('view', 'click') AND volume % 2 = 0 AND side = 'ask'"))
def _(spark, sf_dir):
    return C.filter_spec(
        ticks(spark, sf_dir),
        {"price": (10, 200), "event_type": ["view", "click"], "volume": lambda c: c % 2 == 0, "side": "ask", "absent": 1},
    ).select("symbol", "seq", "event_type", "price")


@query("query_string", f"WITH {TICKS} " + rounded("symbol seq", "price volume", "ticks WHERE price > 50 AND volume < 20"))
def _(spark, sf_dir):
    return C.query_rows(ticks(spark, sf_dir), "price > 50 and volume < 20").select("symbol", "seq", "price", "volume")


@query(
    "message_predicate",
    f"""WITH {TICKS}, m AS (SELECT max(ts) AS now FROM ticks) SELECT seq, price > 0 AND price <= 1000000 AND volume >= 0 AND (bid = 0 OR bid < ask)
        AND abs(epoch_us(now) - epoch_us(ts)) <= 300000000 AS ok FROM ticks, m""",
)
def _(spark, sf_dir):
    """Replay: "now" is the newest time in the data (one row, joined on)."""
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts").alias("now"))
    return t.crossJoin(F.broadcast(now)).select(
        "seq", C.plausible_message(quantity="volume", now=F.col("now")).alias("ok")
    )


@query(
    "message_predicate_quality",
    f"""WITH {TICKS}, o AS (SELECT seq, price, volume, avg(price) OVER w AS m, count(*) OVER w AS n FROM ticks WINDOW w AS ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
        SELECT seq, price <= 0 AS bad_price, volume < 0 AS bad_volume, volume * 100 > 5000 AS too_old,
        coalesce(n >= 5 AND abs(price - m) / m > 0.05, FALSE) AS outlier FROM o""",
)
def _(spark, sf_dir):
    df = cleaning.recent_mean_outlier(ticks(spark, sf_dir))
    faults = C.message_faults(age_ms=F.col("volume") * 100, outlier=F.col("is_outlier"))
    return df.select("seq", *[c.alias(n) for n, c in faults.items()])


@query(
    "recent_mean_outlier",
    f"""WITH {TICKS} SELECT symbol, seq, round(m, 6) AS recent_mean, coalesce(n >= 5 AND abs(price - m) / m > 0.05, FALSE) AS is_outlier FROM (
        SELECT *, avg(price) OVER w AS m, count(*) OVER w AS n FROM ticks WINDOW w AS ({W} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))""",
)
def _(spark, sf_dir):
    return cleaning.recent_mean_outlier(ticks(spark, sf_dir)).select("symbol", "seq", "recent_mean", "is_outlier")


@query(
    "clean_price_series",
    f"""WITH {TICKS}, s AS (SELECT symbol, avg(price) AS m, stddev_pop(price) AS sd, count(*) AS n FROM ticks WHERE price > 0 GROUP BY symbol)
        SELECT t.symbol, t.seq, round(t.price, 6) AS price FROM ticks t JOIN s USING (symbol) WHERE t.price > 0 AND (n <= 10 OR abs(t.price - m) <= 2 * sd)""",
)
def _(spark, sf_dir):
    return cleaning.clean_price_series(ticks(spark, sf_dir), sigmas=2.0).select("symbol", "seq", "price")


@query("clean_snapshot", f"WITH {TICKS} SELECT symbol, seq, bid > 0 AND ask > 0 AND bid < ask AS ok FROM ticks")
def _(spark, sf_dir):
    return ticks(spark, sf_dir).select("symbol", "seq", C.quote_valid().alias("ok"))


@query(
    "signature_dedup",
    """WITH RECURSIVE n AS (
      SELECT user_id, event_type, w, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type, w ORDER BY ts, event_id) AS i FROM (SELECT *, round(value, 0) AS w FROM events)),
    k AS (
      SELECT user_id, event_type, w, i, event_id, ts AS kept, TRUE AS keep FROM n WHERE i = 1 UNION ALL
      SELECT n.user_id, n.event_type, n.w, n.i, n.event_id, CASE WHEN n.ts - k.kept > INTERVAL 1 HOUR THEN n.ts ELSE k.kept END, n.ts - k.kept > INTERVAL 1 HOUR
      FROM k JOIN n ON n.user_id = k.user_id AND n.event_type = k.event_type AND n.w = k.w AND n.i = k.i + 1)
    SELECT event_id FROM k WHERE keep""",
)
def _(spark, sf_dir):
    src = table(spark, sf_dir, "events").withColumn("whole", F.round("value"))
    return cleaning.signature_dedup(
        src, signature=("user_id", "event_type", "whole"), horizon_seconds=3600, order=("ts", "event_id")
    ).select("event_id")
