"""Hot keys cut into blocks give the result of the plain plan."""

import numpy as np
import pandas as pd
import pytest
from conftest import same
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.operators import aggregates, bars, books, cleaning, eventlog, features, models, pnl, quality, risk, signals
from tickloom.plans import gram, shuffling, sliding
from tickloom.plans.decay import Decay, by_span, decayed
from tickloom.plans.merging import asof_join
from tickloom.plans.pairs import pair_moments
from tickloom.plans.recurrence import recurrence
from tickloom.plans.series import hot_keys, numbered, quantiles, running, spec, windowed

N = 30


def test_hot_key_is_found(hot_ticks):
    hot = hot_keys(hot_ticks, ("symbol",), 200)
    assert [r[0] for r in hot.table.collect()] == ["hot"]
    assert hot_keys(hot_ticks, ("symbol",), None) is None


def test_windowed(hot_ticks):
    def add(d, w):
        return d.withColumns({"l": F.lag("price", 3).over(w), "m": F.avg("price").over(w.rowsBetween(-9, 0)), "n": F.lead("price", 2).over(w)})

    same(windowed(hot_ticks, add, back=9, ahead=2), windowed(hot_ticks, add, back=9, ahead=2, rows_per_task=N))


def test_frame_wider_than_a_block(hot_ticks):
    def add(d, w):
        return d.withColumn("m", F.sum("price").over(w.rowsBetween(-99, 0)))

    same(windowed(hot_ticks, add, back=100), windowed(hot_ticks, add, back=100, rows_per_task=10))


def test_running(hot_ticks):
    values = {
        "s": ("sum", F.col("price")), "hi": ("max", F.col("price")), "lo": ("min", F.col("price")), "n": ("count", F.lit(1)),
        "last": ("last", F.when(F.col("seq") % 7 == 0, F.col("price"))),
    }
    same(running(hot_ticks, values), running(hot_ticks, values, rows_per_task=N))


def test_numbered_without_keys(hot_ticks):
    a = numbered(hot_ticks, keys=(), order=("ts", "seq"), rows_per_task=100)
    got = [r["pos"] for r in a.orderBy("ts").collect()]
    assert got == list(range(1, len(got) + 1))


def test_quantiles(hot_ticks):
    p = {"a": 0.05, "b": 0.5, "c": 1.0}
    same(quantiles(hot_ticks, "price", p), quantiles(hot_ticks, "price", p, rows_per_task=N))
    same(quantiles(hot_ticks, "price", p, keys=()), quantiles(hot_ticks, "price", p, keys=(), rows_per_task=N))


def test_decay_equals_pandas(hot_ticks):
    got = decayed(hot_ticks, [Decay("e", "price", 0.1), by_span("f", "price", 12)], rows_per_task=600).toPandas().set_index("seq")
    pdf = hot_ticks.toPandas().sort_values(["symbol", "ts", "seq"]).set_index("seq")
    g = pdf.groupby("symbol")["price"]
    want_e = g.transform(lambda s: s.ewm(alpha=0.1, adjust=False).mean())
    want_f = g.transform(lambda s: s.ewm(span=12).mean())
    assert (got["e"] - want_e).abs().max() < 1e-9
    assert (got["f"] - want_f).abs().max() < 1e-9


def test_recurrence_equals_loop(hot_ticks):
    d = hot_ticks.withColumns({"a": F.when(F.col("seq") % 11 == 0, 0.0).otherwise(0.9), "b": F.col("price")})
    for rows in (None, N):
        got = recurrence(d, "a", "b", "y", before="y0", rows_per_task=rows).toPandas().sort_values(["symbol", "ts"])
        y, symbol = 0.0, None
        for r in got.itertuples():
            if r.symbol != symbol:
                y, symbol = 0.0, r.symbol
            assert r.y0 == pytest.approx(y)
            y = r.a * y + r.b
            assert r.y == pytest.approx(y)


def test_asof_equals_pandas(hot_ticks):
    left = hot_ticks.filter("seq % 2 = 1").select("symbol", "ts", "seq", "price")
    right = hot_ticks.filter("seq % 2 = 0").select("symbol", "ts", "seq", F.col("price").alias("quote"))
    want = pd.merge_asof(
        left.toPandas().sort_values("ts"), right.toPandas().sort_values("ts").drop(columns="seq"), on="ts", by="symbol"
    ).set_index("seq")["quote"]
    for rows in (None, N):
        got = asof_join(left, right, rows_per_task=rows).toPandas().set_index("seq")["quote"]
        assert (got.fillna(-1).sort_index() == want.fillna(-1).sort_index()).all()


def test_asof_takes_quote_of_same_time(spark):
    left = spark.createDataFrame([Row(symbol="A", ts=5, seq=1, price=1.0)])
    right = spark.createDataFrame([Row(symbol="A", ts=5, seq=9, quote=2.0)])
    assert asof_join(left, right).first()["quote"] == 2.0


def test_pair_moments_equal_self_join(hot_ticks):
    day = hot_ticks.groupBy("symbol", F.date_trunc("day", "ts").alias("bar")).agg(F.avg("price").alias("price"))
    x, y = day.alias("x"), day.alias("y")
    sums = {"sx": "x.price", "sy": "y.price", "sxx": "x.price*x.price", "syy": "y.price*y.price", "sxy": "x.price*y.price"}
    want = x.join(y, F.col("x.bar") == F.col("y.bar")).filter("x.symbol <= y.symbol").groupBy(
        F.col("x.symbol").alias("a"), F.col("y.symbol").alias("b")
    ).agg(F.count("*").alias("n"), *[F.expr(f"sum({e})").alias(k) for k, e in sums.items()])
    same(pair_moments(day, groups=3, slices=4, diagonal=True), want, places=5)


HOT_OPERATORS = {
    "compute": lambda d, n: features.compute(d, ["sma_20", "rsi_14", "volatility_10", "ema_12", "price_impact_2", "autocorr_1"], rows_per_task=n),
    "macd": lambda d, n: features.macd_hist(d, rows_per_task=n),
    "vwap": lambda d, n: features.running_vwap(d, rows_per_task=n),
    "ffill": lambda d, n: features.forward_fill(d.withColumn("price", F.when(F.col("seq") % 3 == 0, F.col("price"))), ["price"], rows_per_task=n),
    "lags": lambda d, n: features.lag_features(d, rows_per_task=n),
    "sessions": lambda d, n: features.sessions(d, rows_per_task=n),
    "outlier": lambda d, n: cleaning.recent_mean_outlier(d, rows_per_task=n),
    "median": lambda d, n: cleaning.median_filter(d, rows_per_task=n),
    "winsorise": lambda d, n: cleaning.winsorise_returns(d, rows_per_task=n),
    "temporal": lambda d, n: quality.temporal_report(d, rows_per_task=n),
    "mad": lambda d, n: quality.outlier_flags(d, "price", rows_per_task=n),
    "fifo": lambda d, n: pnl.fifo_pnl(d.fillna({"side": "ask"}).withColumn("volume", F.col("volume") + 1), rows_per_task=n),
    "avg_cost": lambda d, n: pnl.average_cost(d.fillna({"side": "ask"}).withColumn("volume", F.col("volume") + 1), rows_per_task=n),
    "drawdown": lambda d, n: risk.drawdown(d, "price", rows_per_task=n),
    "momentum": lambda d, n: signals.momentum(d, rows_per_task=n),
    "ma_cross": lambda d, n: signals.ma_cross(d, rows_per_task=n),
    "best_quote": lambda d, n: books.best_quote_ffill(d, rows_per_task=n),
    "execution": lambda d, n: aggregates.execution_quality(d, rows_per_task=n),
    "split": lambda d, n: models.time_series_split(d, rows_per_task=n),
    "regime": lambda d, n: models.regime_change(d, "price", rows_per_task=n),
    "scaled": lambda d, n: models.normalise_features(d.select("seq", "price", "volume"), "mad", ["seq"], rows_per_task=n),
    "versions": lambda d, n: eventlog.versioned(d.withColumn("aggregate_id", F.col("symbol")), rows_per_task=n),
    "filled_bars": lambda d, n: bars.ohlc(d, 60, rows_per_task=n),
    "indicators": lambda d, n: bars.classic_indicators(bars.ohlc(d, 3600, fill_empty=False), rows_per_task=n),
}


@pytest.mark.parametrize("name", sorted(HOT_OPERATORS))
def test_operator_with_hot_key(name, hot_ticks):
    op = HOT_OPERATORS[name]
    same(op(hot_ticks, None), op(hot_ticks, 150), places=6)


def test_plain_plan_shuffles_once(hot_ticks):
    names = ["sma_20", "rsi_14", "vwap_20", "volatility_10", "bb_position_20_2", "autocorr_2"]
    plan = features.compute(hot_ticks, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_topk_is_cut_before_the_shuffle(hot_ticks):
    plan = books.recent(hot_ticks, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_needed_columns(spark, sf):
    from tickloom.sources.standins import ticks

    plan = ticks(spark, sf).filter("price > 100").groupBy("symbol").agg(F.sum("price"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan
    assert "GreaterThan(value,100.0)" in plan


def test_no_global_window(hot_ticks):
    plan = features.compute(hot_ticks, ["sma_20"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_time_cells_shrink_to_fit(hot_ticks):
    def add(d, w):
        return d.withColumn("n", F.count("*").over(w.rangeBetween(-3_600_000_000, 0)))

    from tickloom.plans.series import time_windowed

    wide = time_windowed(hot_ticks, add, seconds_back=3600, cell_seconds=86_400)
    same(wide, time_windowed(hot_ticks, add, seconds_back=3600, cell_seconds=86_400, rows_per_task=5))
    by_symbol = {r.seq: r.n for r in wide.collect()}
    rows = hot_ticks.select("symbol", F.unix_micros("ts").alias("us"), "seq").collect()
    for r in rows[:50]:
        assert by_symbol[r.seq] == sum(1 for x in rows if x.symbol == r.symbol and 0 <= r.us - x.us <= 3_600_000_000)


def test_quantiles_of_many_ties(spark):
    """Nine tenths one value: a hot key's ties are one counted row."""


    df = spark.range(2_000).select(
        F.when(F.col("id") % 4 == 0, "cold").otherwise("hot").alias("symbol"), F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id") * 1.0).alias("v")
    )
    probs = {"low": 0.01, "mid": 0.5, "high": 0.957, "top": 1.0}
    same(quantiles(df, "v", probs, rows_per_task=50), quantiles(df, "v", probs))


def test_decays_over_nulls(spark):
    # constant but for nulls, and a gappy series

    rows = [("a", i, v) for i, v in enumerate([None, 10.0, 10.0, None, 10.0, 10.0, 10.0])] + [("b", i, None if i % 3 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, seq long, price double")
    how = {"order": ("seq",)}
    out = decayed(df, [by_span("span", "price", 5), Decay("alpha", "price", 0.3)], **how)
    for r in out.where("symbol = 'a'").collect():
        assert (r["span"] is None) == (r["seq"] == 0) and (r["seq"] == 0 or abs(r["span"] - 10) < 1e-12 and abs(r["alpha"] - 10) < 1e-12)
    same(out, decayed(df, [by_span("span", "price", 5), Decay("alpha", "price", 0.3)], rows_per_task=7, **how))


def test_tight_pairs_keep_their_correlation(spark):
    import numpy as np

    from tickloom.plans.pairs import centred_moments, pair_stats

    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = x + 0.1 * rng.normal(size=400)
    rows = [("x", i, 1e5 + float(v)) for i, v in enumerate(x)] + [("y", i, 1e5 + float(v)) for i, v in enumerate(y)] + [("z", i, 7.1) for i in range(400)]
    out = {(r["a"], r["b"]): r for r in pair_stats(centred_moments(spark.createDataFrame(rows, "symbol string, bar long, price double"))).collect()}
    assert abs(out["x", "y"]["corr"] - np.corrcoef(x, y)[0, 1]) < 1e-8 and out["x", "z"]["corr"] is None


def test_unknown_sides_and_missing_prices(spark):


    rows = [(1, "bid", 10.0, 5.0), (2, None, 4.0, 5.0), (3, "bid", 10.0, None), (4, "hold", 1.0, 9.0), (5, "ask", 5.0, 7.0), (6, "ask", None, 7.0)]
    df = spark.createDataFrame([("s", i, i, side, v, p) for i, side, v, p in rows], "symbol string, ts long, seq long, side string, volume double, price double")
    last = pnl.cash_and_position(df).where("seq = 6").first()
    assert (last["position"], last["cash"]) == (5.0, -15.0) and pnl.unplaced_fills(df).count() == 4
    book = {r["seq"]: r["position"] for r in pnl.average_cost(df).collect()}
    assert book == {1: 10.0, 2: 10.0, 3: 10.0, 4: 10.0, 5: 5.0, 6: 5.0}
    assert [r["pnl"] for r in pnl.fifo_pnl(df.where("price IS NOT NULL")).collect()] == [10.0]


def test_normal_distribution(spark):
    import math



    from tickloom.operators.options import normal_cdf

    for r in spark.range(-160, 161).select((F.col("id") / 20).alias("x")).select("x", normal_cdf(F.col("x")).alias("p")).collect():
        assert abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 2e-15


def test_long_gap_in_bars(spark):




    df = spark.createDataFrame([("s", 0, 1.0), ("s", 86_400 * 30, 2.0)], "symbol string, seq long, price double").withColumns(
        {"ts": F.timestamp_seconds("seq"), "volume": F.lit(1.0)}
    )
    out = bars.ohlc(df, 60)
    assert out.count() == 1_440 * 30 + 1 and out.select("bar").distinct().count() == 1_440 * 30 + 1


def test_sliding_equals_plain_frames():
    """Prices of 1e5 that move by 1, runs shorter and longer than the frame."""
    rng = np.random.default_rng(0)
    for rows in (1, 5, 63, 1000):
        v = 1e5 + rng.standard_normal(rows)
        for n in (1, 2, 7, 64, 200):
            for kind in sliding.KINDS:
                got = sliding.sliding(v, kind, n)
                for i in range(0, rows, max(1, rows // 40)):
                    frame = v[i - n + 1 : i + 1]
                    if i < n - 1 or kind == "stddev_samp" and n == 1:
                        assert np.isnan(got[i])
                        continue
                    want = {
                        "avg": frame.mean, "sum": frame.sum, "min": frame.min, "max": frame.max, "median": lambda f=frame: np.median(f),
                        "stddev_samp": lambda f=frame: (f - 1e5).std(ddof=1), "stddev_pop": lambda f=frame: (f - 1e5).std(),
                    }[kind]()
                    assert got[i] == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_wide_frames_equal_windows(spark, hot_ticks, monkeypatch):
    """Nulls, several keys in a batch and one key over several batches and blocks."""
    t = hot_ticks.withColumn("price", F.when(F.col("seq") % 97 == 0, None).otherwise(F.col("price")))
    stats = ("mean", "std", "min", "max", "median")
    monkeypatch.setattr(features, "WIDE", 10**9)
    want = features.rolling_statistics(t, "price", 30, stats[:4])
    w = spec(("symbol",), ("ts", "seq"))
    frame = w.rowsBetween(-29, 0)
    want = want.withColumn("price_median_30", F.when(F.count("price").over(frame) >= 30, F.percentile("price", F.lit(0.5)).over(frame)))
    monkeypatch.setattr(features, "WIDE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        for rows_per_task in (None, 50):
            same(features.rolling_statistics(t, "price", 30, stats, rows_per_task=rows_per_task), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_combined_signals_equal_brute_force(spark):
    """Bursts, ties of time, cells that a signal reaches into, signals too weak to count, nulls."""
    rng = np.random.default_rng(4)
    rows = []
    for symbol, n, span in (("a", 300, 20.0), ("b", 60, 900.0), ("c", 1, 1.0), (None, 5, 2.0)):
        for k in range(n):
            rows.append((symbol, round(float(rng.uniform(0, span)), 1), rng.choice(["momentum", "order_flow", "other"]).item(), float(rng.uniform(-1, 1)), float(rng.uniform(0, 1))))
    rows += [("a", 1.0, "momentum", None, 0.5), ("a", 1.0, "momentum", 0.5, None), ("d", 3.0, "momentum", 0.1, 0.9), ("d", 4.0, "momentum", 0.9, 0.05)]
    df = spark.createDataFrame(rows, "symbol string, s double, kind string, strength double, confidence double").withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))).drop("s")
    weights = dict(signals.KIND_WEIGHTS)
    for seconds, decay, cell in ((5.0, 0.95, 7.0), (3.0, 1.0, 3600.0), (400.0, 0.9, 50.0)):
        want = {}
        for symbol, s, *_ in rows:
            live = [(st * decay ** (s - t), c * decay ** (s - t), weights.get(kind, 0.1)) for sy, t, kind, st, c in rows if sy == symbol and st is not None and c is not None and 0 <= s - t < seconds - 1e-9]
            live = [x for x in live if abs(x[0]) > 0.1 and x[1] > 0.1]
            if live:
                total = sum(w * c for _, c, w in live)
                want[symbol, round(s * 1e6)] = (len(live), total, sum(st * c * w for st, c, w in live) / total, max(c for _, c, _ in live) * min(1, total / 0.5))
        got = signals.combine(df, seconds=seconds, decay=decay, cell_seconds=cell)
        found = {(r["symbol"], r["us"]): (r["components"], r["total_weight"], r["combined"], r["combined_confidence"]) for r in got.withColumn("us", F.unix_micros("ts")).collect()}
        assert found.keys() == want.keys()
        for k, v in want.items():
            assert found[k] == pytest.approx(v, rel=1e-9)


def test_a_burst_of_signals(spark):
    """Ten thousand signals of one symbol in one second."""
    df = spark.range(10_000).select(F.lit("a").alias("symbol"), F.timestamp_micros(F.col("id") * 100).alias("ts"), F.lit("momentum").alias("kind"), F.lit(0.5).alias("strength"), F.lit(0.5).alias("confidence"))
    last = signals.combine(df, decay=1.0).orderBy(F.desc("ts")).first()
    assert last["components"] == 10_000 and last["combined"] == pytest.approx(0.5) and last["total_weight"] == pytest.approx(1250.0)


def test_performance_of_signals(spark):
    df = spark.createDataFrame([("a", 0.5, 0.4, True), ("a", -0.1, 0.2, None), ("b", 1.0, 1.0, False)], "kind string, strength double, confidence double, acted boolean")
    got = {r["kind"]: tuple(r)[1:] for r in signals.performance(df, F.col("acted")).collect()}
    assert got["a"] == pytest.approx((2, 0.2, 0.3, 0.3, 0.5)) and got["b"] == pytest.approx((1, 1.0, 1.0, 1.0, 0.0))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_are_one_to_one(spark, n):
    moved = spark.range(n).select(shuffling.permuted_place(F.col("id"), F.lit(n), F.lit(5)).alias("to"), F.col("id"))
    places = [r["to"] for r in moved.orderBy("id").collect()]
    assert sorted(places) == list(range(n))
    if n == 1000:
        assert places != list(range(n)) and abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.1
        other = [r["to"] for r in spark.range(n).orderBy("id").select(shuffling.permuted_place(F.col("id"), F.lit(n), F.lit(6)).alias("to")).collect()]
        assert places != other


def test_column_moments_equal_numpy(spark):
    """High levels with small moves, a null, many columns."""
    rng = np.random.default_rng(2)
    x = 1e6 + rng.standard_normal((700, 30)) @ rng.standard_normal((30, 30))
    rows = [tuple(map(float, r)) for r in x] + [(None,) * 30]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(30))).repartition(6)
    n, mean, covariance = gram.column_moments(df, df.columns)
    assert n == 700 and mean == pytest.approx(x.mean(axis=0), rel=1e-13) and np.abs(covariance - np.cov(x.T)).max() < 1e-7
    assert gram.column_moments(df.limit(0), df.columns)[0] == 0


def test_robust_distance_finds_what_a_plain_one_hides(spark):
    """A cluster of a third of the rows that pulls the plain covariance towards itself."""
    rng = np.random.default_rng(8)
    good = rng.standard_normal((400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    bad = rng.standard_normal((160, 3)) * 0.2 + np.array([9.0, -9.0, 9.0])
    rows = [(i, *map(float, r)) for i, r in enumerate(np.vstack([good, bad]))] + [(9999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    share = 160 / 560
    flagged = lambda d: {r["id"] for r in d.where("is_anomaly").collect()}
    robust, plain = models.robust_distance(df, ["a", "b", "c"], share), models.anomaly_distance(df, ["a", "b", "c"], share)
    planted = set(range(400, 560))
    assert len(flagged(robust) & planted) >= 158 and len(flagged(plain) & planted) < 100
    # Concentration steps by hand.
    x = np.vstack([good, bad])
    centre = np.median(x, axis=0)
    scale = 1.4826 * np.median(np.abs(x - centre), axis=0)
    d = (((x - centre) / scale) ** 2).sum(axis=1)
    for _ in range(20):
        near = x[d <= np.quantile(d, 0.5)]
        mean, inverse = near.mean(axis=0), np.linalg.inv(np.cov(near.T))
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    d *= 3 * (1 - 2 / 27) ** 3 / np.median(d)
    got = {r["id"]: r["distance"] for r in robust.collect()}
    assert got.pop(9999) is None
    assert np.array([got[i] for i in range(560)]) == pytest.approx(d, rel=1e-6)
    none = models.robust_distance(df.limit(0), ["a", "b"])
    assert none.count() == 0 and set(none.columns) >= {"distance", "is_anomaly"}
