"""Streams fed in several files and restarted give the batch result."""

import pytest
from conftest import same
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.sources.standins import ticks
from tickloom.operators import cleaning
from tickloom.streaming import carry, counters, enrich, monitor, ordered


def feed(spark, df, path, parts):
    """Write time slices one after the other, yielding after each."""
    ordered = df.orderBy("ts")
    bounds = [r[0] for r in ordered.select(F.ntile(parts).over(Window.orderBy("ts")).alias("n"), "ts").groupBy("n").agg(F.max("ts").alias("t")).orderBy("n").select("t").collect()]
    low = None
    for high in bounds:
        part = ordered.filter(F.col("ts") <= F.lit(high))
        if low is not None:
            part = part.filter(F.col("ts") > F.lit(low))
        part.coalesce(1).write.mode("append").parquet(path)
        low = high
        yield


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def kinds(df):
    return df.select("symbol", "ts", "seq", "price", F.when(F.col("event_type") == "purchase", "trade").otherwise("tick").alias("kind"))


def test_enrich_over_restarts_equals_batch(spark, sf, tmp_path):
    df = kinds(ticks(spark, sf))
    src, out, state, cp = (str(tmp_path / x) for x in ("src", "out", "state", "cp"))
    for _ in feed(spark, df, src, 4):
        carry.run_with_carry(source(spark, df, src), enrich.enrich_batch, out, state, cp).awaitTermination()
    want, _ = enrich.enrich_batch(df, None)
    same(spark.read.parquet(out).drop("batch"), want)
    hot, _ = enrich.enrich_batch(df, None, rows_per_task=20)
    same(hot, want)


def test_first_tick_has_no_change_and_early_trade_no_side(spark):
    df = spark.createDataFrame(
        [("A", 1, 1, "trade", 5.0), ("A", 2, 2, "tick", 10.0), ("A", 3, 3, "trade", 10.0), ("A", 4, 4, "tick", 11.0), ("A", 5, 5, "trade", 9.0)],
        "symbol string, ts long, seq long, kind string, price double",
    )
    out, after = enrich.enrich_batch(df, None)
    assert [(r.price_change, r.side) for r in out.orderBy("seq").collect()] == [(None, None), (None, None), (None, "buy"), (1.0, None), (None, "sell")]
    assert [tuple(r) for r in after.collect()] == [("A", 4, 4, 11.0)]


def test_book_state_over_restarts(spark, tmp_path):
    rows = [("A", 1, 1, "bid", 10.0, 5.0), ("A", 2, 2, "bid", 10.0, 0.0), ("A", 3, 3, "ask", 11.0, 4.0), ("A", 4, 4, "bid", 9.0, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, ts long, seq long, side string, price double, qty double")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for _ in feed(spark, df, src, 2):
        carry.run_updates(enrich.book_levels(source(spark, df, src)), out, cp).awaitTermination()
    got = carry.latest(spark.read.parquet(out), ["symbol", "side", "price"]).filter("qty > 0")
    assert sorted((r.side, r.price, r.qty) for r in got.collect()) == [("ask", 11.0, 4.0), ("bid", 9.0, 7.0)]


def test_late_rows_are_dropped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "symbol string, s long, seq long, price double, volume double"

    def push(rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
        carry.run_append(monitor.event_bars(stream, "1 minute", lateness="1 minute"), out, cp).awaitTermination()

    push([("A", 10, 1, 1.0, 1.0), ("A", 20, 2, 2.0, 1.0)])
    push([("A", 600, 3, 3.0, 1.0)])
    push([("A", 30, 4, 9.0, 1.0), ("A", 1200, 5, 4.0, 1.0)])
    push([("A", 2400, 6, 5.0, 1.0)])
    got = {r.start.minute * 60 + r.start.second: r for r in spark.read.parquet(out).collect()}
    assert (got[0].open, got[0].close, got[0].trades) == (1.0, 2.0, 2)
    assert got[600].trades == 1


def test_alert_is_muted(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [("A", 0, 0.2), ("A", 60, 0.3), ("A", 120, 0.05), ("B", 60, 0.5)]
    df = spark.createDataFrame(rows, "source string, s long, drawdown double").select(
        F.timestamp_seconds("s").alias("ts"), "source", "drawdown", F.lit(0.0).alias("volatility"), F.lit(0).alias("risk_events")
    )
    df.coalesce(1).write.parquet(src)
    carry.run_append(monitor.muted(monitor.alerts(spark.readStream.schema(df.schema).parquet(src))), out, cp).awaitTermination()
    assert sorted((r.source, r.title) for r in spark.read.parquet(out).collect()) == [("A", "drawdown"), ("B", "drawdown")]


def test_latency_sketches_merge_within_the_bound(spark, sf):
    t = ticks(spark, sf)
    windows = monitor.latency_windows(t, "price", span="1 day", k=64)
    got = monitor.with_percentiles(monitor.merged_latency(windows, k=64)).first()
    n = t.count()
    assert got["n"] == n
    for name, p in monitor.PERCENTILES.items():
        rank = t.filter(F.col("price") <= got[name]).count() / n
        assert abs(rank - p) <= 2 * monitor.rank_bound(64)
    # A window no larger than the sketch is exact.
    whole = monitor.with_percentiles(monitor.latency_windows(t, "price", span="1 day", k=2000)).orderBy("start").collect()
    want = t.groupBy(F.window("ts", "1 day").start.alias("start")).agg(F.sort_array(F.collect_list("price")).alias("v")).orderBy("start").collect()
    assert [r["p95"] for r in whole] == [w["v"][-(-len(w["v"]) * 95 // 100) - 1] for w in want]


def run_in_batches(spark, df, transform, base, files, cuts, ts="ts"):
    """Run a stream over ``df`` dealt over ``files`` files in ``cuts`` runs, then close it; (what came out, total counts)."""
    src, out, cp = (f"{base}/{x}" for x in ("src", "out", "cp"))
    with counters.Counts(spark) as counts:
        for k in range(cuts + 1):
            if k < cuts:
                df.filter(F.pmod(F.xxhash64("seq"), F.lit(cuts)) == k).repartition(files, "seq").write.mode("append").parquet(src)
            else:
                ordered.closing(df, ts, src)
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)
            counts.finished(ordered.start(spark, lambda: carry.run_append(transform(stream), out, cp)))  # noqa: B023
        return spark.read.parquet(out), counts.totals(), cp


def test_ordered_enrichment_does_not_depend_on_batches(spark, sf, tmp_path):
    """Rows dealt over files without regard to time, in one, two and many batches."""
    df = kinds(ticks(spark, sf))
    want, _ = enrich.enrich_batch(df, None)
    for k, (files, cuts) in enumerate([(1, 1), (2, 2), (3, 3)]):
        got, counts, _ = run_in_batches(spark, df, lambda s: ordered.enriched(s, "60 days"), tmp_path / str(k), files, cuts)
        same(got, want)
        assert counts["late_rows"] == 0


def test_ordered_enrichment_of_odd_rows(spark, tmp_path):
    rows = [
        ("A", 5, 1, "tick", 10.0), ("A", 5, 2, "tick", 11.0), ("A", 5, None, "tick", 9.0), ("A", 6, 3, "trade", None), ("A", 7, 4, "tick", None), ("A", 8, 5, "trade", 11.0),
        (None, 5, 1, "tick", 1.0), (None, 6, 2, "tick", 2.0), ("A", None, 9, "tick", 1.0), ("B", 5, 1, "tick", 0.0), ("B", 6, 2, "tick", 3.0), ("B", 7, 3, None, 3.0),
    ]
    df = spark.createDataFrame(rows, "symbol string, s long, seq long, kind string, price double").select("symbol", F.timestamp_seconds("s").alias("ts"), "seq", "kind", "price")
    got, _, _ = run_in_batches(spark, df, ordered.enriched, tmp_path, 2, 1)
    found = {(r.symbol, r.seq): (r.price_change, r.price_change_pct, r.side) for r in got.collect()}
    assert found == {
        ("A", None): (None, None, None), ("A", 1): (1.0, 1.0 / 9 * 100, None), ("A", 2): (1.0, 10.0, None), ("A", 3): (None, None, "sell"), ("A", 4): (None, None, None),
        ("A", 5): (None, None, "buy"), (None, 1): (None, None, None), (None, 2): (1.0, 100.0, None), ("B", 1): (None, None, None), ("B", 2): (3.0, None, None), ("B", 3): (None, None, None),
    }


def test_empty_levels_leave_the_state(spark, tmp_path):
    """Ten levels are set, nine are emptied; one that is not changed any more goes after its time to live."""
    rows = [("A", i, i, "bid", float(i), 5.0) for i in range(10)] + [("A", 100 + i, 100 + i, "bid", float(i), 0.0) for i in range(9)]
    schema = "symbol string, s long, seq long, side string, price double, qty double"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    held = []
    for part in (df.filter("seq < 100"), df.filter("seq >= 100"), spark.createDataFrame([("B", 1000, 1000, "ask", 1.0, 1.0)], schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        ordered.start(spark, lambda: carry.run_append(ordered.book_levels(stream, "1 second", "10 minutes"), out, cp)).awaitTermination()  # noqa: B023
        held.append(spark.read.format("statestore").option("stateVarName", "levels").load(cp).count())
    # The newest two rows of a run are still held back.
    assert held == [8, 2, 0]
    last = spark.read.parquet(out).groupBy("price").agg(F.max_by("qty", "ts").alias("qty")).filter("qty > 0").count()
    assert last == 0


def test_one_meaning_of_deduplication(spark, tmp_path):
    """First row, then the first one beyond the horizon of the last row kept, in batch and stream; ties by the order columns."""
    rows = [("x", s, i) for i, s in enumerate([0, 50, 100, 100, 161, 220, 222])] + [("y", 10, 20), ("y", 10, 19), (None, 5, 30), (None, 6, 31), ("z", None, 40)]
    df = spark.createDataFrame(rows, "k string, s long, seq long").select("k", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "seq")
    batch = monitor.dedup(df, ["k"], horizon="60 seconds", order=["seq"])
    assert sorted(r.seq for r in batch.collect()) == [0, 2, 4, 6, 19, 30]
    for cuts in (1, 3):
        got, counts, _ = run_in_batches(spark, df, lambda s: monitor.dedup(s, ["k"], horizon="60 seconds", order=["seq"], lateness="1 hour"), tmp_path / str(cuts), 2, cuts)
        same(got, batch)
        assert counts["late_rows"] == 0


def test_planted_late_repeated_and_faulty_rows_are_counted(spark, tmp_path):
    schema = "k string, s long, seq long, price double"
    first = [(f"k{i}", 1000 + i, i, 1.0) for i in range(20)]
    second = [(f"k{i}", 1000 + i, 100 + i, 1.0) for i in range(15, 20)] + [("old", 10 + i, 200 + i, 1.0) for i in range(7)] + [("bad", 5000 + 100 * i, 300 + i, -1.0) for i in range(4)]
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    with counters.Counts(spark) as counts:
        for rows in (first, second, None):
            df = spark.createDataFrame(rows or [], schema).withColumn("ts", F.timestamp_seconds("s"))
            if rows is None:
                ordered.closing(df, "ts", src)
            else:
                df.coalesce(1).write.mode("append").parquet(src)
            stream = counters.seen(spark.readStream.schema(df.schema).parquet(src), "read")
            kept = counters.seen(monitor.dedup(stream, ["k"], horizon="60 seconds", lateness="60 seconds"), "kept", faulty=F.col("price") <= 0)
            counts.finished(ordered.start(spark, lambda: carry.run_append(kept, out, cp)))  # noqa: B023
        told, table = counts.totals(), counts.table()
    assert told["input_rows"] == 37 == told["read.rows"] and told["late_rows"] == 7 and told["kept.faulty"] == 4
    assert told["input_rows"] - 1 - told["late_rows"] - told["kept.rows"] == 5
    assert table.agg(F.sum("late_rows")).first()[0] == 7 and table.select("batch", "run").distinct().count() == table.count()


def test_signature_dedup_in_blocks(spark):
    """A hot signature cut into blocks gives the rows of one walk over all of it."""
    rows = [("hot" if i % 3 else f"s{i % 50}", (i * 7919) % 20_000, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, s long, seq long").select("k", F.timestamp_seconds("s").alias("ts"), "seq")
    for horizon in (0, 5, 90, 4000, 50_000):
        want, last = [], {}
        for k, s, seq in sorted(rows, key=lambda r: (r[1], r[2])):
            if k not in last or s > last[k] + horizon:
                last[k] = s
                want.append(seq)
        for most in (None, 500, 37):
            got = cleaning.signature_dedup(df, ["k"], horizon, rows_per_task=most)
            assert sorted(r.seq for r in got.collect()) == sorted(want)


def test_intervals():
    assert ordered.interval_micros("10 minutes") == 600_000_000 and ordered.interval_micros("1 day 2 hours") == 93_600_000_000
    for odd in ("", "month", "1 month", "3"):
        with pytest.raises(ValueError):
            ordered.interval_micros(odd)


def test_quality_grades(spark):
    row = [(100.0, 0.0, 1.0, 100.0, 0.0, 5.0), (900.0, 0.2, 0.5, 50.0, 400.0, 0.1)]
    df = spark.createDataFrame(row, "latency_p95 double, error_rate double, pass_rate double, uptime_pct double, staleness_seconds double, per_second double")
    good, bad = monitor.quality_score(df).collect()
    assert good.quality_score == 97.5 and good.status == "EXCELLENT" and good.advice == []
    assert bad.status == "POOR" and len(bad.advice) == 5


def test_checkpoint_can_be_inspected(spark, sf, tmp_path):
    df = ticks(spark, sf).select("symbol", "seq", "price")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src).groupBy("symbol").agg(F.count("*").alias("n"))
    carry.run_updates(stream, out, cp).awaitTermination()
    state = spark.read.format("statestore").load(cp)
    assert state.count() == df.select("symbol").distinct().count()


def test_old_states_are_removed(spark, tmp_path):
    src, out, state, cp = (str(tmp_path / x) for x in ("src", "out", "state", "cp"))
    batches = carry.KEEP_STATES + 2
    df = spark.range(batches).select(
        F.lit("A").alias("symbol"), "id", F.col("id").alias("ts"), F.col("id").alias("seq"), F.lit("tick").alias("kind"), F.col("id").cast("double").alias("price")
    ).drop("id")
    df.repartition(batches, "seq").write.option("maxRecordsPerFile", 1).parquet(src)
    carry.run_with_carry(source(spark, df, src), enrich.enrich_batch, out, state, cp).awaitTermination()
    kept = sorted(int(p.name) for p in (tmp_path / "state").iterdir())
    assert kept[-1] >= batches - 1 and kept == list(range(kept[-1] - carry.KEEP_STATES + 1, kept[-1] + 1))
    assert spark.read.parquet(out).count() == batches
