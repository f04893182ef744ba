"""Data-quality rules."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import BOOK_LEVELS, TICKS, W, query
from tickloom.functions.checks import SIDES, order_faults
from tickloom.operators import quality as Q
from tickloom.sources.standins import book_levels, table, ticks


def _rows(spark, sf_dir):
    """Ticks with faults by event type: shifted prices, emptied volumes, odd sides."""
    k = F.col("event_type")
    return ticks(spark, sf_dir).withColumns(
        {
            "price": F.when(k == "error", F.col("price") - 20).otherwise(F.col("price")),
            "volume": F.when((k == "view") & (F.col("volume") > 90), F.lit(None).cast("double")).otherwise(F.col("volume")),
            "side": F.coalesce("side", F.lit("hold")),
            "order_type": F.when(k == "signup", "stop").otherwise("limit"),
        }
    )


_ROWS = f"""{TICKS}, r AS (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN price - 20 ELSE price END AS price,
  CASE WHEN event_type = 'view' AND volume > 90 THEN NULL ELSE volume END AS volume, coalesce(side, 'hold') AS side),
  CASE WHEN event_type = 'signup' THEN 'stop' ELSE 'limit' END AS order_type FROM ticks)"""


@query(
    "dq_schema",
    f"""WITH {TICKS}, n AS (SELECT count(*) AS n, count(ts) AS timestamp, count(price) AS price, count(volume) AS volume, count(side) AS side,
      count(seq) AS order_id, count(symbol) AS symbol, count(event_type) AS event_type FROM ticks)
    SELECT t.*, CAST(coalesce(v, 0) AS BIGINT) AS n_values, CAST((SELECT n FROM n) - coalesce(v, 0) AS BIGINT) AS n_nulls
    FROM (VALUES ('timestamp', 'required', TRUE, 'timestamp'), ('price', 'required', TRUE, 'double'), ('volume', 'required', TRUE, 'double'), ('side', 'optional', TRUE, 'string'),
    ('order_type', 'optional', FALSE, NULL), ('order_id', 'optional', TRUE, 'bigint'), ('symbol', 'optional', TRUE, 'string'), ('event_type', 'unexpected', TRUE, 'string')) t("column", kind, present, type)
    LEFT JOIN (UNPIVOT (SELECT * EXCLUDE n FROM n) ON COLUMNS(*) INTO NAME c VALUE v) u ON u.c = t."column" """,
)
def _(spark, sf_dir):
    df = ticks(spark, sf_dir).select(
        F.col("ts").alias("timestamp"), "price", "volume", "side", F.col("seq").alias("order_id"), "symbol", "event_type"
    )
    return Q.schema_report(df)


@query(
    "dq_types",
    """SELECT count(*) FILTER (event_type = 'error') AS bad_price_type, count(*) FILTER (event_type = 'view') AS bad_volume_type,
       count(*) FILTER (event_type = 'click') AS bad_time FROM events""",
)
def _(spark, sf_dir):
    k = F.col("event_type")
    text = ticks(spark, sf_dir).select(
        F.when(k == "error", "x1").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(k == "view", "many").otherwise(F.col("volume").cast("string")).alias("volume"),
        F.when(k == "click", "later").otherwise(F.col("ts").cast("string")).alias("timestamp"),
    )
    return Q.count_flags(text, Q.type_flags())


@query(
    "dq_ranges",
    f"""WITH {_ROWS} SELECT count(*) FILTER (price < 0) AS negative_prices, count(*) FILTER (price = 0) AS zero_prices, count(*) FILTER (price > 1000000) AS high_prices,
    count(*) FILTER (price > 0 AND price < 0.0001) AS low_prices, count(*) FILTER (volume < 0) AS negative_volumes, count(*) FILTER (volume = 0) AS zero_volumes,
    count(*) FILTER (volume > 1000000) AS high_volumes FROM r""",
)
def _(spark, sf_dir):
    return Q.count_flags(_rows(spark, sf_dir), Q.range_flags())


@query("dq_missing", f"WITH {_ROWS} SELECT count(*) FILTER (ts IS NULL) AS missing_ts, count(*) FILTER (price IS NULL) AS missing_price, count(*) FILTER (volume IS NULL) AS missing_volume, CAST(0 AS BIGINT) AS empty_rows FROM r")
def _(spark, sf_dir):
    df = _rows(spark, sf_dir)
    return Q.count_flags(df, Q.missing_flags(df.columns, ["ts", "price", "volume"]))


_SIDES = """b AS (SELECT symbol, ts, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask, count(*) AS rows FROM lv GROUP BY symbol, ts)"""


@query("dq_crossed", f"WITH {BOOK_LEVELS}, {_SIDES} SELECT symbol, ts, best_bid, best_ask, rows FROM b WHERE best_bid > best_ask")
def _(spark, sf_dir):
    return Q.crossed(book_levels(spark, sf_dir))


@query("dq_enums", f"WITH {_ROWS} SELECT 'side' AS column_name, side AS value, count(*) AS n FROM r WHERE side NOT IN ('bid', 'ask', 'buy', 'sell') GROUP BY side UNION ALL SELECT 'order_type', order_type, count(*) FROM r WHERE order_type NOT IN ('market', 'limit', 'cancel', 'modify') GROUP BY order_type")
def _(spark, sf_dir):
    df = _rows(spark, sf_dir)
    sides = Q.offenders(df, "side", SIDES).select(F.lit("side").alias("column_name"), "value", "n")
    kinds = Q.offenders(df, "order_type", Q.ORDER_TYPES).select(F.lit("order_type").alias("column_name"), "value", "n")
    return sides.unionByName(kinds)


@query(
    "dq_temporal",
    """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, epoch_us(l_shipdate) AS us, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, l_quantity AS q FROM lineitem),
    a AS (SELECT *, us < lag(us) OVER (PARTITION BY symbol ORDER BY seq, q) AS un FROM t),
    b AS (SELECT *, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq, q) AS step FROM a)
    SELECT symbol, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (step = 0) AS duplicates, count(*) FILTER (step > 3600000000) AS gaps,
    count(*) FILTER (us > epoch_us(TIMESTAMP '2001-06-01')) AS future FROM b GROUP BY symbol""",
)
def _(spark, sf_dir):
    """`unsorted` is left out here: order lines repeat their sequence numbers, so ingest order has ties."""
    src = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return Q.temporal_report(src, now=F.lit("2001-06-01").cast("timestamp")).drop("unsorted")


@query(
    "dq_temporal_ingest",
    """WITH a AS (SELECT event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) - 600000000 END AS us, event_id FROM events),
    b AS (SELECT *, us < lag(us) OVER (PARTITION BY symbol ORDER BY event_id) AS un, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, event_id) AS step FROM a)
    SELECT symbol, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (un) AS unsorted, count(*) FILTER (step = 0) AS duplicates,
    count(*) FILTER (step > 3600000000) AS gaps, CAST(0 AS BIGINT) AS future FROM b GROUP BY symbol""",
)
def _(spark, sf_dir):
    """Odd users report ten minutes early, which puts rows out of order."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    src = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"),
        F.timestamp_micros(F.when(F.col("user_id") % 2 == 0, us).otherwise(us - 600_000_000)).alias("ts"),
    )
    return Q.temporal_report(src)


@query(
    "dq_microstructure",
    f"""WITH {TICKS}, d AS (SELECT *, abs(price - lag(price) OVER ({W})) AS step, price / lag(price) OVER ({W}) - 1 AS ret FROM ticks),
    g AS (SELECT symbol, min(CASE WHEN step > 1e-12 THEN step END) AS min_tick, stddev_samp(ret) AS return_std, count(*) AS rows FROM d GROUP BY symbol)
    SELECT symbol, round(min_tick, 6) AS min_tick, round(return_std, 6) AS return_std, rows, coalesce(min_tick < 0.001, FALSE) AS tiny_tick,
    coalesce(rows > 100 AND return_std > 0.5, FALSE) AS volatile FROM g""",
)
def _(spark, sf_dir):
    return Q.microstructure_report(ticks(spark, sf_dir))


@query("dq_wide_spread", f"WITH {BOOK_LEVELS}, {_SIDES} SELECT symbol, ts, best_bid, best_ask, rows, round((best_ask - best_bid) / ((best_bid + best_ask) / 2), 6) AS relative_spread FROM b WHERE best_ask > best_bid AND (best_ask - best_bid) / ((best_bid + best_ask) / 2) > 0.1")
def _(spark, sf_dir):
    return Q.wide_spread(book_levels(spark, sf_dir))


@query(
    "dq_outliers",
    f"""WITH {TICKS}, m AS (SELECT symbol, median(price) AS med FROM ticks GROUP BY symbol), a AS (SELECT symbol, median(abs(price - med)) AS mad FROM ticks JOIN m USING (symbol) GROUP BY symbol),
    q AS (SELECT symbol, quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.75) AS q3, avg(price) AS mean, stddev_pop(price) AS sd FROM ticks GROUP BY symbol)
    SELECT t.symbol, t.seq, coalesce(0.6745 * abs(price - med) / nullif(mad, 0) > 5, FALSE) AS price_outlier,
    volume < q1 - 0.6 * (q3 - q1) OR volume > q3 + 0.6 * (q3 - q1) AS volume_outlier, coalesce(abs(price - mean) / nullif(sd, 0) > 3, FALSE) AS z_outlier
    FROM ticks t JOIN m USING (symbol) JOIN a USING (symbol) JOIN q USING (symbol)""",
)
def _(spark, sf_dir):
    df = Q.outlier_flags(ticks(spark, sf_dir), "price", name="price_outlier")
    df = Q.outlier_flags(df, "volume", "iqr", 0.6, name="volume_outlier")
    df = Q.outlier_flags(df, "price", "z", 3.0, name="z_outlier")
    return df.select("symbol", "seq", "price_outlier", "volume_outlier", "z_outlier")


@query("dq_book_structure", f"WITH {BOOK_LEVELS} SELECT symbol, ts, max(CAST(side = 'bid' AS INT)) AS has_bids, max(CAST(side = 'ask' AS INT)) AS has_asks, count(*) AS levels, count(*) > 10 AS too_many FROM lv GROUP BY symbol, ts")
def _(spark, sf_dir):
    return Q.book_structure(book_levels(spark, sf_dir), most=10)


@query(
    "dq_summary",
    f"""WITH {_ROWS}, f AS (SELECT price < 0 AS negative_prices, volume = 0 AS zero_volumes, volume IS NULL AS missing_volume, side NOT IN ('bid', 'ask', 'buy', 'sell') AS bad_side FROM r)
    SELECT 'total_rows' AS rule, 'total' AS level, count(*) AS n FROM f UNION ALL
    SELECT 'valid_rows', 'total', count(*) FILTER (NOT (coalesce(negative_prices, FALSE) OR coalesce(zero_volumes, FALSE) OR missing_volume)) FROM f UNION ALL
    SELECT 'negative_prices', 'error', count(*) FILTER (negative_prices) FROM f UNION ALL SELECT 'zero_volumes', 'error', count(*) FILTER (zero_volumes) FROM f UNION ALL
    SELECT 'missing_volume', 'error', count(*) FILTER (missing_volume) FROM f UNION ALL SELECT 'bad_side', 'warning', count(*) FILTER (bad_side) FROM f""",
)
def _(spark, sf_dir):
    df = _rows(spark, sf_dir)
    ranges = Q.range_flags()
    errors = {n: ranges[n] for n in ("negative_prices", "zero_volumes")} | {"missing_volume": F.col("volume").isNull()}
    return Q.summary(df, errors, Q.enum_flags(order_type=None))


@query(
    "data_profile",
    f"""WITH {_ROWS} SELECT count(*) AS rows, count(*) FILTER (price IS NULL OR volume IS NULL) AS null_rows, min(ts) AS first_ts, max(ts) AS last_ts,
    round(min(price), 5) AS price_min, round(max(price), 5) AS price_max, round(avg(price), 5) AS price_mean, round(stddev_samp(price), 5) AS price_std,
    sum(volume) AS volume_sum, round(avg(volume), 5) AS volume_mean, median(volume) AS volume_median FROM r""",
    digits=5,
)
def _(spark, sf_dir):
    return Q.profile(_rows(spark, sf_dir))


@query(
    "dq_order_record",
    f"""WITH {_ROWS} SELECT seq, list_filter([CASE WHEN volume IS NULL THEN 'Missing required field: volume' END,
     CASE WHEN NOT price BETWEEN 0.0001 AND 1000000 THEN 'Price out of valid range' END,
     CASE WHEN NOT floor(volume) BETWEEN 1 AND 1000000 THEN 'Volume out of valid range' END,
     CASE WHEN side NOT IN ('bid', 'ask', 'buy', 'sell') THEN 'Invalid side: ' || side END], lambda x: x IS NOT NULL) AS faults FROM r""",
)
def _(spark, sf_dir):
    return _rows(spark, sf_dir).select("seq", order_faults().alias("faults"))


@query("clean_stats", f"WITH {TICKS} SELECT count(*) AS loaded, count(*) FILTER (NOT (price BETWEEN 0.0001 AND 1000000 AND volume BETWEEN 1 AND 1000000)) AS dropped FROM ticks")
def _(spark, sf_dir):
    """Counters collected while the cleaned rows are written."""
    import uuid

    from tickloom.functions.checks import clean_row

    kept, watch = Q.observed(ticks(spark, sf_dir), f"clean-{uuid.uuid4().hex}", clean_row())
    kept.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(watch.get["loaded"], watch.get["dropped"])], "loaded bigint, dropped bigint")
