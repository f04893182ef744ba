"""Scans and sinks."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import TICKS, query, rounded
from tickloom.functions.checks import clean_row_fast
from tickloom.sources import feeds, files, topics
from tickloom.sources.standins import table, ticks

_TICK_FILE = ("timestamp", "price", "volume", "side", "order_id", "symbol")


def _tick_text(spark, sf_dir):
    """The ticks as a delimited file would hold them; error rows lack a side."""
    return ticks(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("price").cast("string").alias("price"),
        F.col("volume").cast("string").alias("volume"),
        F.coalesce("side", F.lit("NULL")).alias("side"),
        F.col("seq").cast("string").alias("order_id"),
        "symbol",
    )


def _tick_csv(spark, sf_dir):
    path = files.derived_path(spark, "ticks-csv")
    _tick_text(spark, sf_dir).write.option("header", True).csv(path)
    return path


_TICK_ROWS = rounded("ts side seq symbol", "price volume", "ticks")


@query("csv_scan", f"WITH {TICKS} {_TICK_ROWS}")
def _(spark, sf_dir):
    raw = files.csv_scan(spark, _tick_csv(spark, sf_dir), _TICK_FILE)
    df = files.resolve_columns(raw)
    return df.select(F.col("timestamp").alias("ts"), "side", F.col("order_id").alias("seq"), "symbol", "price", "volume")


@query("csv_chunk_scan", f"WITH {TICKS} {_TICK_ROWS} WHERE price > 0 AND price < 1000000 AND volume >= 1 AND volume <= 1000000")
def _(spark, sf_dir):
    raw = files.csv_scan(spark, _tick_csv(spark, sf_dir), _TICK_FILE)
    df = files.standard_clean(files.resolve_columns(raw))
    return df.select(F.col("timestamp").alias("ts"), "side", F.col("order_id").alias("seq"), "symbol", "price", "volume")


@query(
    "csv_parallel_scan",
    f"WITH {TICKS} " + rounded("seq symbol", "notional", "(SELECT seq, symbol, price * volume AS notional FROM ticks WHERE price > 0 AND price < 1e6 AND volume > 0 AND volume < 1e9)"),
)
def _(spark, sf_dir):
    raw = files.csv_scan(spark, _tick_csv(spark, sf_dir), _TICK_FILE)
    df = files.resolve_columns(raw).filter(clean_row_fast())
    return df.transform(
        lambda d: d.select(F.col("order_id").alias("seq"), "symbol", (F.col("price") * F.col("volume")).alias("notional"))
    )


@query(
    "dir_scan_symbol_from_name",
    f"WITH {TICKS} " + rounded("symbol ts", "price volume", "(SELECT upper(event_type) AS symbol, ts, price, volume FROM ticks)"),
)
def _(spark, sf_dir):
    """A folder of files named after their type; Spark's own names are changed once they are written."""
    path, raw = files.derived_path(spark, "dir"), files.derived_path(spark, "dir-raw")
    src = ticks(spark, sf_dir).select(
        "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("price").cast("string").alias("price"), F.col("volume").cast("string").alias("volume"),
    )
    # One scan for all types.
    src.write.partitionBy("event_type").option("header", True).csv(raw)
    for kind in ("click", "error", "purchase", "signup", "view"):
        files.name_parts(spark, f"{raw}/event_type={kind}", path, kind)
    df = files.dir_scan(spark, path, ("timestamp", "price", "volume"))
    return files.resolve_columns(df).select("symbol", F.col("timestamp").alias("ts"), "price", "volume")


@query("parquet_scan", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 100 GROUP BY event_type", digits=2)
def _(spark, sf_dir):
    return (
        table(spark, sf_dir, "events").filter(F.col("value") > 100).groupBy("event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


@query(
    "csv_to_parquet",
    f"WITH {TICKS} " + rounded("ts side order_type order_id symbol", "price volume", "(SELECT ts, side, CAST(NULL AS VARCHAR) AS order_type, seq AS order_id, symbol, price, volume FROM ticks)"),
)
def _(spark, sf_dir):
    path = files.derived_path(spark, "tick-parquet")
    raw = files.csv_scan(spark, _tick_csv(spark, sf_dir), _TICK_FILE)
    files.write_tick_parquet(files.resolve_columns(raw), path)
    return files.read_tick_parquet(spark, path).select(
        F.col("timestamp").alias("ts"), "side", "order_type", "order_id", "symbol", "price", "volume"
    )


@query("file_metadata")
def _(spark, sf_dir):
    df = files.file_metadata(spark, sf_dir, "*.parquet")
    return df.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size_bytes", "extension", "speed")


_EVENT_LOG = (
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS aggregate_id, ts, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
)


def event_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.col("user_id").cast("string").alias("aggregate_id"), F.lit("user").alias("aggregate_type"),
        F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("version"),
        F.create_map(F.lit("source"), F.lit("web")).alias("metadata"),
    )


@query("jsonl_event_source_sink", _EVENT_LOG)
def _(spark, sf_dir):
    path = files.derived_path(spark, "event-log")
    files.append_jsonl(event_rows(spark, sf_dir), path)
    return files.read_jsonl(spark, path).select(
        "event_id", "event_type", "aggregate_id", "ts", F.get_json_object("data", "$.k").cast("long").alias("k")
    )


@query(
    "topic_source_sink",
    f"""WITH {TICKS}, m AS (SELECT CASE event_type WHEN 'view' THEN 'market-data-level2' WHEN 'purchase' THEN 'market-data-trades'
        ELSE 'market-data-level1' END AS topic, symbol AS key, price FROM ticks)
        SELECT topic, key, count(*) AS n, round(sum(price), 4) AS total FROM m GROUP BY topic, key""",
    digits=4,
)
def _(spark, sf_dir):
    """Messages written to topic files and read back as a stream until all are taken."""
    kind = F.when(F.col("event_type") == "view", "level2").when(F.col("event_type") == "purchase", "trades").otherwise("level1")
    folder, out = files.derived_path(spark, "topics"), files.derived_path(spark, "topic-out")
    src = ticks(spark, sf_dir).select("symbol", "ts", "price", "event_type")
    topics.to_messages(src, topics.topic_of("market", kind), F.col("symbol")).write.json(folder)
    stream = topics.read_topics(spark, list(topics.TOPICS["market"].values()), folder=folder)
    q = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", files.derived_path(spark, "topic-cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = topics.from_messages(spark.read.parquet(out), "symbol string, price double")
    return rows.groupBy("topic", "key").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def raw_messages(spark, sf_dir):
    """Ticks as exchange text: five message shapes, one of them not JSON, by event type."""
    t = ticks(spark, sf_dir)
    ms = F.unix_millis("ts")
    text = F.col("price").cast("string")

    def pack(**cols):
        return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))

    sym = F.concat(F.lit("s"), "symbol")
    ticker = pack(e=F.lit("24hrTicker"), E=ms, s=sym, c=text, v=F.col("volume").cast("string"),
                  b=F.col("bid").cast("string"), a=F.col("ask").cast("string"))
    trade = pack(stream=F.lit("x@trade"), data=F.struct(
        F.lit("trade").alias("e"), ms.alias("T"), sym.alias("s"), F.col("seq").alias("t"), text.alias("p"),
        F.col("volume").cast("string").alias("q"), (F.col("volume") > 50).alias("m")))
    book = pack(e=F.lit("bookTicker"), s=sym, b=F.col("bid").cast("string"), a=F.col("ask").cast("string"),
                B=F.col("bid_volume").cast("string"), A=F.col("ask_volume").cast("string"))
    depth = pack(e=F.lit("depthUpdate"), E=ms, s=sym,
                 b=F.array(F.array(F.col("bid").cast("string"), F.lit("2")), F.array((F.col("bid") - 1).cast("string"), F.lit("5"))),
                 a=F.array(F.array(F.col("ask").cast("string"), F.lit("0")), F.array((F.col("ask") + 1).cast("string"), F.lit("4"))))
    value = (
        F.when(F.col("event_type") == "view", ticker).when(F.col("event_type") == "purchase", trade)
        .when(F.col("event_type") == "click", book).when(F.col("event_type") == "signup", depth)
        .otherwise(F.concat(F.lit("{bad "), text))
    )
    return t.select("seq", value.alias("value"))


@query(
    "feed_normalise",
    f"WITH {TICKS} " + rounded(
        "seq symbol event_type trade_id is_buyer_maker source_ms fault", "price quantity best_bid best_ask best_bid_qty best_ask_qty",
        """(SELECT seq, CASE WHEN event_type <> 'error' THEN 'S' || symbol END AS symbol,
            CASE event_type WHEN 'view' THEN 'ticker' WHEN 'purchase' THEN 'trade' WHEN 'click' THEN 'book_ticker' WHEN 'signup' THEN 'depth' END AS event_type,
            CASE WHEN event_type = 'purchase' THEN CAST(seq AS DOUBLE) END AS trade_id,
            CASE WHEN event_type = 'purchase' THEN volume > 50 END AS is_buyer_maker,
            CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CAST(epoch_us(ts) // 1000 AS DOUBLE) END AS source_ms,
            CASE WHEN event_type = 'error' THEN 'not json' END AS fault,
            CASE WHEN event_type IN ('view', 'purchase') THEN price END AS price,
            CASE WHEN event_type IN ('view', 'purchase') THEN volume END AS quantity,
            CASE WHEN event_type IN ('view', 'click', 'signup') THEN bid END AS best_bid,
            CASE WHEN event_type IN ('view', 'click') THEN ask WHEN event_type = 'signup' THEN ask + 1 END AS best_ask,
            CASE WHEN event_type = 'click' THEN bid_volume WHEN event_type = 'signup' THEN 2 END AS best_bid_qty,
            CASE WHEN event_type = 'click' THEN ask_volume WHEN event_type = 'signup' THEN 4 END AS best_ask_qty
            FROM ticks)""",
    ),
)
def _(spark, sf_dir):
    df = feeds.feed_normalise(raw_messages(spark, sf_dir))
    return df.select(
        "seq", "symbol", "event_type", F.col("trade_id").cast("double").alias("trade_id"), "is_buyer_maker",
        F.unix_millis("source_ts").cast("double").alias("source_ms"), "fault", "price", "quantity",
        "best_bid", "best_ask", "best_bid_qty", "best_ask_qty",
    )


@query(
    "feed_normalise_multi_venue",
    f"WITH {TICKS} " + rounded(
        "seq symbol message_type side source unparsed", "price volume bid_price ask_price",
        """(SELECT seq, CASE event_type WHEN 'view' THEN 'S' || symbol WHEN 'purchase' THEN 'S' || symbol
                 WHEN 'click' THEN 'S' || symbol || 'USD' WHEN 'signup' THEN 'S' || symbol || 'USD' ELSE 'S' || symbol END AS symbol,
            CASE event_type WHEN 'view' THEN 'quote' WHEN 'purchase' THEN 'trade' WHEN 'click' THEN 'trade' WHEN 'signup' THEN 'quote' ELSE 'unknown' END AS message_type,
            CASE event_type WHEN 'purchase' THEN CASE WHEN volume > 50 THEN 'sell' ELSE 'buy' END WHEN 'click' THEN 'buy' END AS side,
            CASE event_type WHEN 'view' THEN 'binance_ticker' WHEN 'purchase' THEN 'binance_trade' WHEN 'click' THEN 'coinbase_trade'
                 WHEN 'signup' THEN 'kraken_ticker' ELSE 'other_generic' END AS source,
            FALSE AS unparsed, price,
            CASE WHEN event_type <> 'signup' THEN volume END AS volume,
            CASE WHEN event_type IN ('view', 'signup') THEN bid WHEN event_type = 'error' THEN bid END AS bid_price,
            CASE WHEN event_type IN ('view', 'signup') THEN ask WHEN event_type = 'error' THEN ask END AS ask_price
            FROM ticks)""",
    ),
)
def _(spark, sf_dir):
    t = ticks(spark, sf_dir)
    text = F.col("price").cast("string")
    sym = F.concat(F.lit("s"), "symbol")
    up = F.concat(F.lit("S"), "symbol")

    def pack(**cols):
        return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))

    vol, bid, ask = [F.col(c).cast("string") for c in ("volume", "bid", "ask")]
    data = F.struct(sym.alias("s"), text.alias("c"), vol.alias("v"), bid.alias("b"), ask.alias("a"))
    tdata = F.struct(sym.alias("s"), text.alias("p"), vol.alias("q"), F.col("seq").alias("t"), (F.col("volume") > 50).alias("m"))
    kraken = F.concat(
        F.lit('[7,{"c":["'), text, F.lit('"],"b":["'), bid, F.lit('"],"a":["'), ask, F.lit('"]},"ticker","'), up, F.lit('/USD"]')
    )
    kind = F.col("event_type")
    value = (
        F.when(kind == "view", pack(stream=F.lit("z@ticker"), data=data))
        .when(kind == "purchase", pack(stream=F.lit("z@trade"), data=tdata))
        .when(kind == "click", pack(type=F.lit("match"), product_id=F.concat(up, F.lit("-USD")), price=text, size=vol,
                                    trade_id=F.col("seq"), side=F.lit("buy")))
        .when(kind == "signup", kraken)
        .otherwise(pack(symbol=sym, price=F.col("price"), volume=F.col("volume"), bid=F.col("bid"), ask=F.col("ask")))
    )
    venue = (
        F.when(kind.isin("view", "purchase"), "binance").when(kind == "click", "coinbase")
        .when(kind == "signup", "kraken").otherwise("other")
    )
    df = feeds.feed_normalise_multi_venue(t.select("seq", value.alias("value"), venue.alias("venue")))
    return df.select("seq", "symbol", "message_type", "side", "source", "unparsed", "price", "volume", "bid_price", "ask_price")


@query(
    "tick_generator",
    f"WITH {TICKS} SELECT symbol, count(*) AS rows, TIMESTAMP '2024-01-01 09:30:00' + to_seconds(count(*) - 1) AS last_ts, TRUE AS positive, TRUE AS spread_ok FROM ticks GROUP BY symbol",
)
def _(spark, sf_dir):
    """As many ticks per symbol as the table holds, from its first price."""
    at = F.struct("ts", "seq")
    plan = ticks(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("rows"), F.min_by("price", at).alias("start_price"))
    made = files.generate_ticks(plan)
    width = F.col("ask") - F.col("bid")
    right = F.abs(width - F.greatest(F.col("price") * 1.5e-4, F.lit(0.01))) < 1e-9
    return made.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.max("ts").alias("last_ts"), F.bool_and((F.col("price") > 0) & (F.col("volume") > 0)).alias("positive"),
        F.bool_and(right).alias("spread_ok"),
    )


@query(
    "date_range_scan",
    f"WITH {TICKS} " + rounded("symbol seq ts", "price", "ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'"),
)
def _(spark, sf_dir):
    return files.date_range(ticks(spark, sf_dir), "2024-01-05", "2024-01-10").select("symbol", "seq", "ts", "price")


@query("result_sink_json", f"WITH {TICKS} SELECT symbol, count(*) AS trades, round(sum(price * volume), 2) AS notional FROM ticks GROUP BY symbol", digits=2)
def _(spark, sf_dir):
    path = files.derived_path(spark, "results")
    stats = ticks(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("trades"), F.sum(F.col("price") * F.col("volume")).alias("notional")
    )
    files.write_results(stats.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(4))), path, by="part")
    return spark.read.schema("symbol string, trades bigint, notional double, part int").json(path).drop("part")


@query(
    "metric_long_sink",
    f"""WITH {TICKS}, m AS (SELECT symbol, avg(price) AS mean_price, max(price) AS max_price, sum(volume) AS volume FROM ticks GROUP BY symbol)
    SELECT symbol, 'Price' AS "Category", "Metric", round("Value", 6) AS "Value" FROM (
      SELECT symbol, 'mean_price' AS "Metric", mean_price AS "Value" FROM m UNION ALL SELECT symbol, 'max_price', max_price FROM m
      UNION ALL SELECT symbol, 'volume', volume FROM m)""",
)
def _(spark, sf_dir):
    path = files.derived_path(spark, "metrics")
    wide = ticks(spark, sf_dir).groupBy("symbol").agg(
        F.avg("price").alias("mean_price"), F.max("price").alias("max_price"), F.sum("volume").alias("volume")
    )
    files.metric_long(wide, "Price", ["mean_price", "max_price", "volume"], ids=["symbol"]).write.option("header", True).csv(path)
    return spark.read.schema("symbol string, Category string, Metric string, Value double").option("header", True).csv(path)
