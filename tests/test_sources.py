"""Files, feeds and topics."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.sources import feeds, files, topics

HEADER = "timestamp,price,volume\n"


def test_symbol_from_file_name(spark, tmp_path):
    for name, price in (("BTCUSDT_sample.csv", "50000.5"), ("aapl.csv", "150")):
        (tmp_path / name).write_text(HEADER + f"2024-01-01 09:30:00,{price},0.567\n2024-01-01 09:30:01,NaN,\n")
    (tmp_path / "notes.txt").write_text("no ticks")
    raw = files.dir_scan(spark, str(tmp_path), ["timestamp", "price", "volume"])
    rows = files.resolve_columns(raw).orderBy("symbol", "timestamp").collect()
    assert [(r.symbol, r.price, r.volume) for r in rows] == [
        ("AAPL", 150.0, 0.567), ("AAPL", None, None), ("BTCUSDT", 50000.5, 0.567), ("BTCUSDT", None, None)
    ]


def test_fractional_volume_is_a_parameter(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEADER + "2024-01-01 09:30:00,100,0.5\n2024-01-01 09:30:01,100,5\n")
    df = files.resolve_columns(files.csv_scan(spark, str(tmp_path), ["timestamp", "price", "volume"]))
    assert files.standard_clean(df).count() == 1
    assert files.standard_clean(df, volume_bounds=(1e-9, 1e6)).count() == 2


def test_bad_numbers_and_times_become_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEADER + "soon,abc,1\n01/31/2024 10:00:00,1.5,2\n1706695200,2,3\n")
    rows = files.resolve_columns(files.csv_scan(spark, str(tmp_path), ["timestamp", "price", "volume"])).collect()
    assert rows[0].timestamp is None and rows[0].price is None
    assert rows[1].timestamp.isoformat() == "2024-01-31T10:00:00" == rows[2].timestamp.isoformat()


def test_inferred_names(spark):
    df = spark.createDataFrame([Row(ts="2024-01-01 00:00:00", last_px=10.0, lots_amount=3)])
    assert files.resolve_names(df) == {"timestamp": "ts", "price": "last_px", "volume": "lots_amount"}


def test_missing_time_needs_an_index(spark):
    with pytest.raises(ValueError):
        files.resolve_columns(spark.createDataFrame([Row(price=1.0)]))


def test_parquet_layout_prunes_dates(spark, tmp_path):
    plan = spark.createDataFrame([("A", 200, 100.0)], "symbol string, rows long, start_price double")
    df = files.generate_ticks(plan).select(F.col("ts").alias("timestamp"), "price", "volume", "symbol")
    files.write_tick_parquet(df, str(tmp_path / "t"), "gzip")
    back = files.date_range(files.read_tick_parquet(spark, str(tmp_path / "t")), "2024-01-01", "2024-01-01", ts="timestamp", date="date")
    assert back.count() == 200
    assert "PartitionFilters: [isnotnull(date" in back._jdf.queryExecution().executedPlan().toString()


def feed(spark, *messages):
    return spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value string")


def test_feed_envelopes(spark):
    rows = feeds.feed_normalise(feed(
        spark,
        {"e": "24hrTicker", "E": 1700000000123, "s": "btcusdt", "c": "10.5", "v": "", "b": "10", "a": "11", "B": "1", "A": "2"},
        {"stream": "btcusdt@trade", "data": {"e": "trade", "T": 1700000000123, "s": "btcusdt", "t": 7, "p": "10", "q": "2", "m": True}},
        {"stream": "x@bookTicker", "data": {"s": "x", "b": "1", "B": "3", "a": "2", "A": "4"}},
        {"e": "depthUpdate", "s": "x", "b": [["1", "2"], ["3", "0"]], "a": [["5", "1"], ["4", "2"]]},
        {"hello": 1}, "{broken",
    )).collect()
    assert (rows[0].symbol, rows[0].price, rows[0].quantity, rows[0].best_bid_qty) == ("BTCUSDT", 10.5, None, 1.0)
    assert (rows[1].event_type, rows[1].trade_id, rows[1].is_buyer_maker) == ("trade", 7, True)
    assert (rows[2].best_bid_qty, rows[2].best_ask_qty) == (3.0, 4.0)
    assert (rows[3].best_bid, rows[3].best_ask, rows[3].best_ask_qty) == (1.0, 4.0, 2.0)
    assert [r.fault for r in rows] == [None, None, None, None, "unknown type", "not json"]


def test_maker_flag_reading(spark):
    df = feed(spark, {"stream": "z@trade", "data": {"s": "x", "p": "1", "q": "2", "t": 1, "m": True}}).withColumn("venue", F.lit("binance"))
    assert feeds.feed_normalise_multi_venue(df).first()["side"] == "sell"
    assert feeds.feed_normalise_multi_venue(df, maker_true_is_buy=True).first()["side"] == "buy"


def test_topics(spark):
    names = [t for family in topics.TOPICS.values() for t in family.values()]
    assert len(names) == 13 == len(set(names))
    got = spark.range(1).select(topics.topic_of("market", F.lit("other")).alias("m"), topics.topic_of("risk", F.lit("x")).alias("r")).first()
    assert (got.m, got.r) == ("market-data-level1", None)


def test_price_is_inferred_only_on_request(spark):
    """An account number is no price; what the row index reads is no price either."""
    df = spark.createDataFrame([(1, 70_001, 3), (2, 70_002, 4)], "row_no long, account_id long, retries int")
    plain = files.resolve_columns(df, row_index=F.col("row_no"))
    assert plain.select("price").distinct().collect()[0][0] == files.DEFAULT_PRICE and {"row_no", "account_id", "retries"} <= set(plain.columns)
    with pytest.raises(ValueError, match="more than one"):
        files.resolve_columns(df, row_index=F.col("row_no"), infer=True)
    found = files.resolve_columns(df.drop("retries"), row_index=F.col("row_no"), infer=True)
    assert [r[0] for r in found.select("price").collect()] == [70_001.0, 70_002.0]
