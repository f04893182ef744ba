"""Streaming operators, run to completion over the events file and read back."""

from pyspark.sql import functions as F

from tickloom.catalog.books import depth_deltas
from tickloom.catalog.registry import TICKS, W, query, rounded
from tickloom.catalog.sources import event_rows
from tickloom.sources import files
from tickloom.sources.standins import table, ticks
from tickloom.streaming import carry as C
from tickloom.streaming import counters as K
from tickloom.streaming import enrich as N
from tickloom.streaming import monitor as Q
from tickloom.streaming import ordered as O

# Values a day up to which the percentiles of a day are exact.
_DAY_SKETCH = 4000


def event_stream(spark, sf_dir, closing=None):
    """The events file as a stream, in the shape of ``ticks``, with the rows of a folder ``closing`` if given."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if closing:
        raw = raw.unionByName(spark.readStream.schema(schema).parquet(closing))
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        "event_type", F.col("value").alias("price"), k.alias("volume"),
    )


def _paths(spark, *names):
    return [files.derived_path(spark, f"stream-{n}") for n in names]


def _append(spark, stream):
    out, cp = _paths(spark, "out", "cp")
    C.run_append(stream, out, cp).awaitTermination()
    return spark.read.parquet(out)


def _updates(spark, stream, keys):
    out, cp = _paths(spark, "out", "cp")
    C.run_updates(stream, out, cp).awaitTermination()
    return C.latest(spark.read.parquet(out), keys)


def _closed(spark, sf_dir, begin):
    """Run ``begin(stream)`` over all events, then once more from its checkpoint with a row that closes them."""
    end = _paths(spark, "end")[0]
    events = table(spark, sf_dir, "events")
    events.limit(0).write.parquet(end)
    for last in (False, True):
        if last:
            O.closing(events, "ts", end)
        O.start(spark, lambda: begin(event_stream(spark, sf_dir, end))).awaitTermination()


def _kinds(events):
    return events.withColumn("kind", F.when(F.col("event_type").isin("purchase", "click"), "trade").otherwise("tick"))


def _enriched(spark, sf_dir):
    out, cp = _paths(spark, "out", "cp")
    _closed(spark, sf_dir, lambda s: C.run_append(O.enriched(_kinds(s)), out, cp))
    return spark.read.parquet(out)


_TK = f"{TICKS}, k AS (SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN 'trade' ELSE 'tick' END AS kind FROM ticks)"


@query(
    "st_tick_enrich",
    f"WITH {_TK}, t AS (SELECT symbol, seq, price, lag(price) OVER ({W}) AS p FROM k WHERE kind = 'tick') SELECT symbol, seq, round(price - p, 6) AS price_change, round((price - p) / p * 100, 6) AS price_change_pct FROM t",
)
def _(spark, sf_dir):
    return _enriched(spark, sf_dir).filter("kind = 'tick'").select("symbol", "seq", "price_change", "price_change_pct")


@query(
    "st_trade_classify",
    f"WITH {_TK}, l AS (SELECT *, last_value(CASE WHEN kind = 'tick' THEN price END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS p FROM k) SELECT symbol, seq, CASE WHEN p IS NULL THEN NULL WHEN price >= p THEN 'buy' ELSE 'sell' END AS side FROM l WHERE kind = 'trade'",
)
def _(spark, sf_dir):
    return _enriched(spark, sf_dir).filter("kind = 'trade'").select("symbol", "seq", "side")


@query(
    "st_book_enrich",
    f"""WITH {TICKS} SELECT symbol, seq, round(price - 0.5, 6) AS best_bid, round(price + 0.5, 6) AS best_ask, round(price, 6) AS mid_price, round(1 / price * 100, 5) AS spread_pct FROM ticks WHERE event_type <> 'error'""".replace(", 5) AS spread", ", 6) AS spread"),
)
def _(spark, sf_dir):
    """Two levels a side around the price; error rows have no asks."""
    p = F.col("price")

    def level(x, size):
        return F.struct(x.alias("price"), F.lit(size).alias("size"))

    asks = F.when(F.col("event_type") != "error", F.array(level(p + 1, 3.0), level(p + 0.5, 1.0))).otherwise(F.array().cast("array<struct<price:double,size:double>>"))
    data = F.to_json(F.struct(F.array(level(p - 1, 2.0), level(p - 0.5, 5.0)).alias("bids"), asks.alias("asks")))
    books = N.enrich_books(event_stream(spark, sf_dir).withColumn("data", data))
    return _append(spark, books).select("symbol", "seq", "best_bid", "best_ask", "mid_price", "spread_pct")


@query("st_route_by_type", "SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown' END AS branch, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    out, cp = _paths(spark, "out", "cp")
    C.run_append(N.with_branch(event_stream(spark, sf_dir), ["view", "click", "purchase"]), out, cp, ["branch"]).awaitTermination()
    return spark.read.parquet(out).groupBy("branch").agg(F.count("*").alias("n"))


@query(
    "st_book_state",
    f"""WITH {TICKS}, dl AS (SELECT symbol, ts, seq, coalesce(side, 'bid') AS side, floor(price / 5) AS price, CASE WHEN volume < 30 THEN 0 ELSE volume END AS qty FROM ticks),
    l AS (SELECT symbol, side, price, arg_max(qty, (ts, seq)) AS qty FROM dl GROUP BY symbol, side, price) SELECT * FROM l WHERE qty > 0""",
)
def _(spark, sf_dir):
    path, out, cp = _paths(spark, "deltas", "out", "cp")
    deltas = depth_deltas(spark, sf_dir)
    deltas.write.parquet(path)
    for last in (False, True):
        if last:
            O.closing(deltas.withColumn("price", F.lit(0.0)), "ts", path)
        stream = spark.readStream.schema(deltas.schema).parquet(path).fillna(0.0, ["price"])
        O.start(spark, lambda: C.run_append(O.book_levels(stream), out, cp)).awaitTermination()  # noqa: B023
    newest = F.max_by("qty", F.struct("ts", "seq")).alias("qty")
    return spark.read.parquet(out).groupBy("symbol", "side", "price").agg(newest).filter("qty > 0")


@query("st_dead_letter", "SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS sink, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1", digits=3)
def _(spark, sf_dir):
    good, bad, cp = _paths(spark, "good", "bad", "cp")
    marked = event_stream(spark, sf_dir).withColumn("fault", F.when(F.col("event_type") == "error", "handler failed"))
    C.run_split(marked, "fault", good, bad, cp).awaitTermination()
    sides = [spark.read.parquet(p).agg(F.lit(n).alias("sink"), F.count("*").alias("n"), F.sum("price").alias("total")) for n, p in (("good", good), ("bad", bad))]
    return sides[0].unionByName(sides[1])


@query(
    "st_function_chain",
    f"WITH {TICKS} SELECT seq, round(price * 2, 6) AS price, part FROM (SELECT *, unnest(['a', 'b']) AS part FROM ticks WHERE volume >= 50)",
)
def _(spark, sf_dir):
    """Filter, scale, then one event to two; a fourth function is added and removed again."""
    chain = (
        N.FunctionChain().add("large", lambda d: d.filter("volume >= 50"))
        .add("drop", lambda d: d.filter("false")).remove("drop")
        .add("double", lambda d: d.withColumn("price", F.col("price") * 2))
        .add("split", lambda d: d.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b")))))
    )
    return _append(spark, chain.apply(event_stream(spark, sf_dir))).select("seq", "price", "part")


@query("st_checkpoint", f"WITH {TICKS} SELECT symbol, count(*) AS n, round(sum(price), 4) AS total FROM ticks GROUP BY symbol", digits=4)
def _(spark, sf_dir):
    """Stopped after half of the files and restarted from its checkpoint."""
    src, out, cp = _paths(spark, "src", "out", "cp")
    t = ticks(spark, sf_dir).select("symbol", "seq", "price")
    for half in (0, 1):
        t.filter(F.col("seq") % 2 == half).write.mode("append").parquet(src)
        stream = spark.readStream.schema(t.schema).parquet(src).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total"))
        C.run_updates(stream, out, cp).awaitTermination()
    return C.latest(spark.read.parquet(out), ["symbol"])


@query(
    "st_dedup",
    """WITH RECURSIVE n AS (
      SELECT user_id, event_type, w, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type, w ORDER BY ts, event_id) AS i FROM (SELECT *, floor(value / 100) AS w FROM events)),
    k AS (
      SELECT user_id, event_type, w, i, event_id, ts AS kept, TRUE AS keep FROM n WHERE i = 1 UNION ALL
      SELECT n.user_id, n.event_type, n.w, n.i, n.event_id, CASE WHEN n.ts - k.kept > INTERVAL 3 DAY THEN n.ts ELSE k.kept END, n.ts - k.kept > INTERVAL 3 DAY
      FROM k JOIN n ON n.user_id = k.user_id AND n.event_type = k.event_type AND n.w = k.w AND n.i = k.i + 1)
    SELECT event_id AS seq FROM k WHERE keep""",
)
def _(spark, sf_dir):
    out, cp = _paths(spark, "out", "cp")
    signature = ["symbol", "event_type", "bucket"]
    _closed(spark, sf_dir, lambda s: C.run_append(Q.dedup(s.withColumn("bucket", F.floor(F.col("price") / 100)), signature, horizon="3 days"), out, cp))
    return spark.read.parquet(out).select("seq")


@query(
    "st_validate_split",
    f"""WITH {TICKS}, v AS (SELECT 'U' || symbol AS symbol, CASE WHEN price - 10 <= 0 THEN 'price' WHEN volume - 5 < 0 THEN 'quantity' END AS fault FROM ticks)
    SELECT symbol, count(*) FILTER (fault IS NULL) AS passed, count(*) FILTER (fault = 'price') AS bad_price, count(*) FILTER (fault = 'quantity') AS bad_quantity FROM v GROUP BY symbol""",
)
def _(spark, sf_dir):
    good, bad, cp = _paths(spark, "good", "bad", "cp")

    def begin(events):
        s = events.select(
            F.concat(F.lit("u/"), "symbol").alias("symbol"), "ts", "seq", (F.col("price") - 10).alias("price"), (F.col("volume") - 5).alias("quantity")
        )
        return C.run_split(Q.dedup(Q.validity(Q.normalised(s)), ["seq"], order=["symbol"]), "fault", good, bad, cp)

    _closed(spark, sf_dir, begin)
    both = spark.read.parquet(good).select("symbol", F.lit(None).cast("string").alias("fault")).unionByName(spark.read.parquet(bad).select("symbol", "fault"))
    return both.groupBy("symbol").agg(
        F.count_if(F.col("fault").isNull()).alias("passed"), F.count_if(F.col("fault") == "price").alias("bad_price"),
        F.count_if(F.col("fault") == "quantity").alias("bad_quantity"),
    )


@query(
    "st_throughput",
    f"""WITH {TICKS}, w AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL '1 hour', ts) - INTERVAL '5 hours', time_bucket(INTERVAL '1 hour', ts), INTERVAL '1 hour')) AS start FROM ticks)
    SELECT start, start + INTERVAL '6 hours' AS "end", count(*) AS messages, count(*) FILTER (event_type = 'error') AS failed, round(avg(volume), 6) AS avg_latency, round(count(*) / CAST(21600 AS DOUBLE), 6) AS per_second FROM w GROUP BY start""",
)
def _(spark, sf_dir):
    """Six-hour windows sliding by an hour, as the file holds a few messages an hour."""
    s = Q.throughput(event_stream(spark, sf_dir), span="6 hours", slide="1 hour", failed=F.col("event_type") == "error", latency="volume")
    return _updates(spark, s, ["start", "end"])


@query(
    "st_counts",
    f"""WITH {TICKS}, m AS (SELECT make_timestamp(CAST((epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS BIGINT)) AS mid FROM ticks),
    w AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 AS mark FROM ticks, m WHERE ts < mid)
    SELECT count(*) + count(*) FILTER (ts < mid AND event_type = 'error') + count(*) FILTER (ts >= mid AND event_type = 'view') + 1 AS input_rows,
           count(*) FILTER (ts < mid AND event_type = 'error' AND epoch_us(ts) <= mark) AS late_rows,
           count(*) FILTER (ts >= mid AND event_type = 'view') + count(*) FILTER (ts < mid AND event_type = 'error' AND epoch_us(ts) > mark) AS repeated,
           count(*) FILTER (price < 5) AS dropped, count(*) FILTER (price >= 5) AS passed
    FROM ticks, m, w""",
)
def _(spark, sf_dir):
    """The first half of the events, then the rest with its views twice and errors of the first half again, counted on the way."""
    t = ticks(spark, sf_dir).select("symbol", "ts", "seq", "event_type", "price")
    mid = t.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2)).alias("m")).first()["m"]
    late, view = (F.col("ts") < F.lit(mid)) & (F.col("event_type") == "error"), (F.col("ts") >= F.lit(mid)) & (F.col("event_type") == "view")
    src, out, cp = _paths(spark, "src", "out", "cp")

    def begin():
        stream = K.seen(spark.readStream.schema(t.schema).parquet(src), "read")
        once = K.seen(Q.dedup(stream, ["seq"], horizon="60 days", order=["symbol"], lateness="1 hour"), "kept", dropped=F.col("price") < 5)
        return C.run_append(once.filter("price >= 5"), out, cp)

    with K.Counts(spark) as counts:
        for part in (t.filter(F.col("ts") < F.lit(mid)), t.filter(F.col("ts") >= F.lit(mid)).unionByName(t.filter(late)).unionByName(t.filter(view)), None):
            if part is None:
                O.closing(t, "ts", src)
            else:
                part.write.mode("append").parquet(src)
            counts.finished(O.start(spark, begin))
        told = counts.table()
    sums = told.agg(
        F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"),
        *[F.sum(F.coalesce(F.col("counts")[n], F.lit(0))).alias(n.replace(".", "_")) for n in ("kept.rows", "kept.dropped")],
    )
    # All rows but the closing one are late, kept or repeated.
    repeated = F.col("input_rows") - 1 - F.col("late_rows") - F.col("kept_rows")
    return sums.select("input_rows", "late_rows", repeated.alias("repeated"), F.col("kept_dropped").alias("dropped"), (F.col("kept_rows") - F.col("kept_dropped")).alias("passed"))


@query(
    "st_latency",
    f"""WITH {TICKS} SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(avg(price), 6) AS avg, round(max(price), 6) AS max,
    round(quantile_disc(price, 0.5), 6) AS p50, round(quantile_disc(price, 0.95), 6) AS p95, round(quantile_disc(price, 0.99), 6) AS p99 FROM ticks GROUP BY 1""",
)
def _(spark, sf_dir):
    """Percentiles from a sketch for each day, which is exact as long as it holds all values of the day."""
    windows = Q.latency_windows(event_stream(spark, sf_dir), "price", span="1 day", k=_DAY_SKETCH)
    return Q.with_percentiles(_updates(spark, windows, ["start"])).drop("sketch")


@query(
    "st_latency_merged",
    f"WITH {TICKS} SELECT count(*) AS n, round(avg(price), 6) AS avg, round(max(price), 6) AS max, TRUE AS p50_near, TRUE AS p95_near, TRUE AS p99_near FROM ticks",
)
def _(spark, sf_dir):
    """Latency of the whole feed from the sketches of its days, and whether the percentiles' ranks are inside the stated bound."""
    windows = _updates(spark, Q.latency_windows(event_stream(spark, sf_dir), "price", span="1 day"), ["start"])
    merged = Q.with_percentiles(Q.merged_latency(windows)).drop("sketch")
    ranks = ticks(spark, sf_dir).select("price").crossJoin(F.broadcast(merged.select(*Q.PERCENTILES))).agg(
        *[F.avg((F.col("price") <= F.col(n)).cast("int")).alias(f"_{n}") for n in Q.PERCENTILES]
    )
    # Merging adds a little to the bound of one sketch.
    near = [(F.abs(F.col(f"_{n}") - F.lit(p)) <= 2 * Q.rank_bound()).alias(f"{n}_near") for n, p in Q.PERCENTILES.items()]
    return merged.crossJoin(ranks).select("n", "avg", "max", *near)


@query(
    "st_staleness",
    f"WITH {TICKS}, l AS (SELECT symbol, epoch_us(max(ts)) AS u FROM ticks GROUP BY symbol), a AS (SELECT ((SELECT max(u) FROM l) - u) / CAST(1000000 AS DOUBLE) AS age FROM l) SELECT count(*) AS symbols, round(max(age), 4) AS staleness_seconds, round(avg(age), 4) AS mean_age_seconds FROM a",
    digits=4,
)
def _(spark, sf_dir):
    return Q.staleness(_updates(spark, Q.last_updates(event_stream(spark, sf_dir)), ["symbol"]))


_METRICS = f"""{TICKS}, lt AS (SELECT quantile_cont(price, 0.95) AS p95, avg(CAST(event_type = 'error' AS INT)) AS er, avg(CAST(event_type <> 'error' AS INT)) AS pr, count(*) / CAST(date_diff('second', min(ts), max(ts)) AS DOUBLE) AS ps FROM ticks),
 up AS (SELECT count(DISTINCT epoch_us(ts) // 600000000) / CAST(max(epoch_us(ts) // 600000000) - min(epoch_us(ts) // 600000000) + 1 AS DOUBLE) * 100 AS u FROM ticks),
 sc AS (SELECT *, least(100, greatest(0, greatest(0, 100 - p95 / 10) * 0.25 + greatest(0, 100 - er * 100) * 0.2 + pr * 100 * 0.2 + u * 0.2 + greatest(0, 100 - 30 / CAST(5 AS DOUBLE)) * 0.15)) AS s FROM lt, up)"""


@query("st_quality_score", f"WITH {_METRICS} SELECT round(s, 5) AS quality_score, CASE WHEN s >= 90 THEN 'EXCELLENT' WHEN s >= 80 THEN 'GOOD' WHEN s >= 70 THEN 'FAIR' ELSE 'POOR' END AS status, list_filter([CASE WHEN p95 > 500 THEN 'reduce latency' END, CASE WHEN er / 10 > 0.05 THEN 'review errors' END, CASE WHEN pr < 0.95 THEN 'check source data' END, CASE WHEN ps < 1 THEN 'low message rate' END], lambda x: x IS NOT NULL) AS advice FROM sc", digits=5)
def _(spark, sf_dir):
    """Metrics of the whole feed: price as latency, a tenth of the error rows as errors."""
    from tickloom.operators.aggregates import latency_percentiles

    t = ticks(spark, sf_dir)
    failed = F.col("event_type") == "error"
    p95 = latency_percentiles(t, "price").select(F.col("p95").alias("latency_p95"))
    r = Q.rates(t, [F.col("seq")], failed).select((F.col("error_rate") / 10).alias("error_rate"), "pass_rate")
    per = t.agg((F.count("*") / F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))).alias("per_second"))
    one = p95.crossJoin(r).crossJoin(Q.uptime(t, seconds=600)).crossJoin(per).withColumn("staleness_seconds", F.lit(30.0))
    return Q.quality_score(one).select("quality_score", "status", "advice")


@query(
    "st_rates",
    f"""WITH {TICKS}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, event_type, floor(price / 10) ORDER BY ts, seq) > 1 AS dup, price < 5 AS bad FROM ticks)
    SELECT symbol, count(*) AS messages, round(avg(CAST(dup AS INT)), 6) AS duplicate_rate, round(avg(CAST(bad AS INT)), 6) AS error_rate, round(avg(CAST(NOT bad AS INT)), 6) AS pass_rate FROM d GROUP BY symbol""",
)
def _(spark, sf_dir):
    signature = [F.col("event_type"), F.floor(F.col("price") / 10)]
    return Q.rates(ticks(spark, sf_dir), signature, F.col("price") < 5, ["symbol"])


@query(
    "st_alerts",
    f"""WITH {TICKS}, a AS (SELECT symbol AS source, unnest(list_filter([CASE WHEN price / 500 > 0.1 THEN 'drawdown' END, CASE WHEN volume / 100 > 0.3 THEN 'volatility' END, CASE WHEN seq % 12 > 5 THEN 'risk_events' END], lambda x: x IS NOT NULL)) AS title FROM ticks)
    SELECT DISTINCT source, title FROM a""",
)
def _(spark, sf_dir):
    """A mute period longer than the file, so each alert is raised once per source."""
    m = event_stream(spark, sf_dir).select(
        "ts", F.col("symbol").alias("source"), (F.col("price") / 500).alias("drawdown"), (F.col("volume") / 100).alias("volatility"), (F.col("seq") % 12).alias("risk_events")
    )
    return _append(spark, Q.muted(Q.alerts(m), "60 days")).select("source", "title")


@query("st_replay", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'")
def _(spark, sf_dir):
    log = _paths(spark, "log")[0]
    files.append_jsonl(event_rows(spark, sf_dir).repartition(6, "event_id"), log)
    day = lambda d: F.lit(d).cast("timestamp")
    stream = Q.replay(spark, log, files.EVENT_SCHEMA, day("2024-01-05"), day("2024-01-15"), files_per_batch=2)
    return _append(spark, stream).select("event_id", "event_type", "ts")


_BAR = "arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, count(*) AS trades"


@query(
    "st_event_time_bars",
    f"""WITH {TICKS} """ + rounded('symbol start "end" trades', "open high low close volume", f"""(SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS "end", {_BAR} FROM ticks GROUP BY ALL)"""),
)
def _(spark, sf_dir):
    return _updates(spark, Q.event_bars(event_stream(spark, sf_dir), "6 hours"), ["symbol", "start", "end"])


@query(
    "st_session_bars",
    f"""WITH {TICKS}, o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) < 7200000000 THEN 0 ELSE 1 END AS opens FROM ticks), s AS (SELECT *, sum(opens) OVER ({W} ROWS UNBOUNDED PRECEDING) AS sid FROM o) """
    + rounded('symbol start "end" trades', "open high low close volume", f"""(SELECT symbol, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", {_BAR} FROM s GROUP BY symbol, sid)"""),
)
def _(spark, sf_dir):
    """Session windows of a stream: a session comes out once the watermark has passed it, the last ones after a closing row."""
    out, cp = _paths(spark, "out", "cp")
    _closed(spark, sf_dir, lambda s: C.run_append(Q.event_bars(s, "6 hours", session_gap="2 hours"), out, cp))
    return spark.read.parquet(out)


@query("handlers", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY event_type")
def _(spark, sf_dir):
    """Two subscribers, each storing its own type."""
    view, buy, cp = _paths(spark, "view", "buy", "cp")

    def store(path):
        return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    C.run_handlers(event_stream(spark, sf_dir), "event_type", {"view": store(view), "purchase": store(buy)}, cp).awaitTermination()
    return spark.read.parquet(view).unionByName(spark.read.parquet(buy)).groupBy("event_type").agg(F.count("*").alias("n"))
