"""Plans whose disk, memory or time grew faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import joins, pnl, signals
from tickloom.plans import frontier, pairs, series
from tickloom.plans.merging import overlap_lots
from tickloom.streaming import carry, monitor, ordered


def days(spark, names, times):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", t, float(rng.normal())) for i in range(names) for t in range(times) if (i * 7 + t) % 5]
    return spark.createDataFrame(rows, "symbol string, bar long, price double")


def test_pairs_are_not_shuffled(spark):
    """What meets in a task is blocks of names; with one slice their pairs go nowhere else."""
    out = pairs.centred_moments(days(spark, 20, 6), groups=3, slices=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
    assert pairs._groups(90_000, 30) == 22 and pairs._groups(1_500, 30) == 6 and pairs._groups(10_000, 10**6) == 40


def test_pairs_in_bands_and_slices(spark, monkeypatch):
    df = days(spark, 23, 9).unionByName(days(spark, 2, 4).select(F.concat(F.lit("z"), "symbol").alias("symbol"), (F.col("bar") + 500).alias("bar"), "price"))
    want = {(r["a"], r["b"]): r for r in pairs.centred_moments(df, groups=1, slices=1, diagonal=True).collect()}
    wide = {k: dict(zip(g["bar"], g["price"])) for k, g in df.toPandas().groupby("symbol")}
    assert len(want) == 23 * 24 // 2 + 3
    for (a, b), r in want.items():
        both = sorted(wide[a].keys() & wide[b].keys())
        ca, cb = np.mean(list(wide[a].values())), np.mean(list(wide[b].values()))
        x, y = np.array([wide[a][t] for t in both]) - ca, np.array([wide[b][t] for t in both]) - cb
        assert r["n"] == len(both) and r["last_at"] == both[-1]
        assert np.allclose([r[c] for c in ("ca", "cb", "sx", "sy", "sxx", "syy", "sxy", "last_gap")], [ca, cb, x.sum(), y.sum(), x @ x, y @ y, x @ y, x[-1] - y[-1]])
    monkeypatch.setattr(pairs, "BAND", 16)
    for groups, slices in ((4, 1), (4, 3), (1, 5)):
        got = {(r["a"], r["b"]): r for r in pairs.centred_moments(df, groups=groups, slices=slices, diagonal=True).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert np.allclose(tuple(r)[2:], tuple(want[k])[2:])


def test_keys_of_a_bucket_stay_apart(spark, tmp_path, monkeypatch):
    """All signatures in one bucket of state give the rows of the batch, and idle ones leave it; null and NaN are keys."""
    monkeypatch.setattr(ordered, "BUCKETS", 1)
    rows = [(k, 1000 + s, i, v) for i, (k, s, v) in enumerate([("x", 0, 1.0), ("y", 1, 1.0), ("x", 30, 1.0), (None, 5, float("nan")), (None, 9, float("nan")), ("x", 61, 1.0), ("y", 40, 2.0), ("y", 500, 1.0)])]
    df = spark.createDataFrame(rows, "k string, s long, seq long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "seq", "v")
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in (df.filter("seq < 5"), df.filter("seq >= 5"), None):
        if part is None:
            ordered.closing(df, "ts", src)
        else:
            part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        ordered.start(spark, lambda: carry.run_append(monitor.dedup(stream, ["k", "v"], horizon="60 seconds", lateness="1 hour"), out, cp)).awaitTermination()  # noqa: B023
        timers = spark.read.format("statestore").option("stateVarName", "held").option("flattenCollectionTypes", "false").load(cp)
        assert timers.count() <= 1
    batch = monitor.dedup(df, ["k", "v"], horizon="60 seconds")
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == sorted(r.seq for r in batch.collect()) == [0, 1, 3, 5, 6, 7]
    assert spark.read.format("statestore").option("stateVarName", "last").load(cp).count() == 0


def test_quantiles_of_a_whole_table_move_few_rows(spark, monkeypatch):
    """Of a large table without keys only values near the quantile are sorted, not all of them."""
    def never(*_, **__):
        raise AssertionError("all rows were placed")

    monkeypatch.setattr(series, "place", never)
    monkeypatch.setattr(series, "MIN_ROW_BYTES", 0)
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5000), np.repeat([1.0, 2.0, 5.0], [2000, 2000, 1000]), np.arange(3001.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = series.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.999, "d": 0.0, "e": 1.0}, keys=(), rows_per_task=100).first()
        assert np.allclose(tuple(got), np.quantile(values, [0.1, 0.5, 0.999, 0.0, 1.0]))


def test_pools_that_cannot_win_are_not_shuffled(spark):
    """The cheapest of all pools by (cost, name) for each order, although few pools leave the task that makes them."""
    rng = np.random.default_rng(5)
    pools = [(f"s{i % 3}", f"v{int(rng.integers(900)):03d}", float(rng.choice([98, 99, 100, 100.5])), float(rng.integers(0, 50)) * 1000) for i in range(3000)]
    pools += [("s0", None, 100.0, 49000.0), ("s1", "nan", float("nan"), 1e9), ("s1", "inf", 98.0, float("inf")), ("s2", "none", None, 5e8), ("s2", "low", -3.0, 2e6), ("s0", "odd", 97.0, None)]
    venues = spark.createDataFrame(pools, "symbol string, venue string, venue_price double, liquidity double").repartition(1)
    rows = [(f"{s}/{v}", s, v, 100.0) for s in ("s0", "s1", "s2", "s3") for v in (0.0, 1.0, 3.0, 9.5, 700.0)] + [(None, "s0", 1.0, 100.0), ("n", "s0", None, 100.0), ("twice", "s0", 2.0, 100.0), ("twice", "s1", 9.0, 100.0)]
    schema = "order_key string, symbol string, volume double, primary_price double"
    for more in ([], [("minus", "s0", -4.0, 100.0), ("minus", "s2", 50.0, -100.0)]):
        orders = spark.createDataFrame(rows + more, schema)
        v, pp, d = F.col("volume"), F.col("primary_price"), F.col("liquidity")
        slip = F.when(d > 0, F.least(F.lit(0.5), v * pp / (2 * d))).otherwise(F.lit(1.0))
        met = orders.join(venues, "symbol").withColumn("slippage", slip).filter("slippage <= 0.01")
        pool = F.struct((F.col("venue_price") * (1 + F.col("slippage")) + F.lit(-10.0)).alias("cost"), "venue")
        all_pools = met.groupBy("order_key").agg(F.min(pool).alias("p"))
        off = 0.001 + F.least(F.lit(0.01), v / 100_000)
        main = F.struct((pp * (1 + off)).alias("cost"), F.lit("primary").alias("venue"))
        want = orders.join(all_pools, "order_key", "left").select("order_key", F.least(main, F.coalesce("p", main)).alias("r")).select("order_key", "r.venue", "r.cost")
        got = signals.best_route(orders, venues, gas=-10.0).select("order_key", "venue", "cost")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = signals.best_route(orders, venues)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan
        left = frontier.only_contenders(venues.filter("liquidity > 0"), -10.0, bool(more))
        assert left.count() < (120 if more else 60)


def test_lots_are_computed_once(spark):
    """Buys and sells come from one stored walk over the trades; pieces meet first-in first-out."""
    rows = [("a", 1, "bid", 5.0, 10.0), ("a", 2, "ask", 3.0, 11.0), ("a", 3, "bid", 4.0, 12.0), ("a", 4, "ask", 5.0, 13.0), (None, 5, "bid", 1.0, 1.0), (None, 6, "ask", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, seq long, side string, volume double, price double").withColumn("ts", F.timestamp_seconds("seq"))
    buys, sells = pnl.fifo_lots(df)
    for side in (buys, sells):
        assert "Window" not in side._jdf.queryExecution().optimizedPlan().toString()
    met = overlap_lots(sells, buys).select("symbol", "left.seq", F.col("right.seq").alias("of"), "overlap").collect()
    assert sorted(map(tuple, met), key=str) == [("a", 2, 1, 3.0), ("a", 4, 1, 2.0), ("a", 4, 3, 3.0), (None, 6, 5, 1.0)]
    empty = pnl.fifo_lots(df.filter("seq > 99"))
    assert [x.count() for x in empty] == [0, 0]


def test_own_trades_in_bounded_tasks(spark):
    """Trades are read once, tested by two joins and lie in parts of bounded rows, in which they can be summed."""
    rows = [(i % 7 if i % 5 else None, i % 11 if i % 3 else None, i) for i in range(200)] * 2
    trades = spark.createDataFrame(rows, "buy_order_id long, sell_order_id long, n long")
    own = spark.createDataFrame([(1,), (1,), (4,), (9,), (None,)], "order_id long")
    mine, rest = joins.own_trades(trades, own)
    ours = {1, 4, 9}
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(str(r) for r in rows if r[0] in ours or r[1] in ours)
    assert sorted(map(str, map(tuple, rest.collect()))) == sorted(str(r) for r in rows if not (r[0] in ours or r[1] in ours))
    marked = joins.own_trades(trades, own, mark="own", rows_per_task=50)
    assert marked.filter("own").count() == mine.count() and marked.count() == len(rows)
    plan = marked.groupBy("buy_order_id", "sell_order_id", "own").count()._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "hashpartitioning(sell_order_id" in plan and ", 8), REPARTITION_BY_NUM" in plan
