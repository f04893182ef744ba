"""Small cases worked out by hand, and brute-force loops on random tapes."""

import random

import pytest
from conftest import same
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.functions import checks, scalars
from tickloom.operators import bars, books, options, pnl, risk, signals
from tickloom.plans.series import windowed
from tickloom.sources.files import generate_ticks


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


BOOK = [("bid", 149.95, 100.0), ("bid", 149.90, 200.0), ("bid", 149.85, 150.0), ("ask", 150.05, 100.0), ("ask", 150.10, 200.0), ("ask", 150.15, 150.0)]


@pytest.fixture
def levels(spark):
    return spark.createDataFrame(
        [Row(symbol="A", ts=1, seq=i, side=s, price=p, volume=v) for i, (s, p, v) in enumerate(BOOK)]
    )


def test_snapshot_metrics(levels):
    q = one(books.quote_metrics(books.to_books(levels)))
    assert (q.best_bid, q.best_ask) == (149.95, 150.05)
    assert q.mid_price == pytest.approx(150.0)
    assert q.spread == pytest.approx(0.10)
    assert q.spread_bps == pytest.approx(6.6667, abs=1e-3)
    assert (q.total_bid_volume, q.total_ask_volume, q.imbalance) == (450.0, 450.0, 0.0)
    assert not q.is_crossed and not q.is_locked


def test_market_impact_and_shortage(levels):
    got = {r.side: r for r in books.market_impact(levels, F.lit(250.0)).collect()}
    assert got["ask"].total_cost == pytest.approx(100 * 150.05 + 150 * 150.10)
    short = {r.side: r for r in books.market_impact(levels, F.lit(1000.0)).collect()}
    walked = 100 * 150.05 + 200 * 150.10 + 150 * 150.15
    assert short["ask"].total_cost == pytest.approx(walked + 550 * 150.15)
    assert short["bid"].average_price == pytest.approx((100 * 149.95 + 200 * 149.90 + 150 * 149.85 + 550 * 149.85) / 1000)


def test_empty_side_is_null(levels):
    q = one(books.quote_metrics(books.to_books(levels.filter("side = 'bid'"))))
    assert q.best_ask is None and q.mid_price is None and q.is_crossed is False


def test_microprice(levels):
    q = books.quote_metrics(books.to_books(levels)).select(books.microprice().alias("m"), books.microprice(0.5).alias("h"))
    r = one(q)
    assert r.m == pytest.approx(150.0) and r.h == pytest.approx(75.0)


def test_daily_stats(spark):
    rows = [(150.0, 100.0), (152.0, 200.0), (149.0, 150.0), (151.0, 300.0)]
    df = spark.createDataFrame([Row(symbol="A", s=i, seq=i, price=p, volume=v) for i, (p, v) in enumerate(rows)])
    d = one(bars.daily_stats(df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))))
    assert (d.open, d.high, d.low, d.close, d.volume, d.trades) == (150.0, 152.0, 149.0, 151.0, 750.0, 4)
    assert d.range == 3.0 and d.return_pct == pytest.approx(100 / 150)


def test_empty_bins_are_kept(spark):
    df = spark.createDataFrame([Row(symbol="A", s=s, seq=s, price=float(s), volume=1.0) for s in (0, 5, 185)])
    out = bars.ohlc(df.withColumn("ts", F.timestamp_seconds("s")), 60).orderBy("bar").collect()
    assert [(r.open, r.close, r.volume, r.trades) for r in out] == [
        (0.0, 5.0, 2.0, 2), (None, None, 0.0, 0), (None, None, 0.0, 0), (185.0, 185.0, 1.0, 1)
    ]


TAPE = [("buy", 1.0, 50000.0), ("sell", 0.5, 51000.0), ("buy", 0.3, 52000.0), ("sell", 0.8, 49000.0)]


def tape(spark, rows, symbol="A"):
    return spark.createDataFrame(
        [Row(symbol=symbol, ts=i, seq=i, side=s, volume=float(v), price=float(p)) for i, (s, v, p) in enumerate(rows)]
    )


def test_fifo_of_known_tape(spark):
    got = [(r.ts, round(r.pnl, 6), r.lots) for r in pnl.fifo_pnl(tape(spark, TAPE)).orderBy("ts").collect()]
    assert got == [(1, 500.0, 1), (3, -1400.0, 2)]


def test_average_cost_of_known_tape(spark):
    got = pnl.average_cost(tape(spark, TAPE)).orderBy("ts").collect()
    assert [round(r.position, 9) for r in got] == [1.0, 0.5, 0.8, 0.0]
    assert got[1].realized == pytest.approx(500.0)
    average = (0.5 * 50000 + 0.3 * 52000) / 0.8
    assert got[2].average_price == pytest.approx(average)
    assert got[3].realized_pnl == pytest.approx(500.0 + 0.8 * (49000 - average))


def test_position_flip(spark):
    got = pnl.average_cost(tape(spark, [("buy", 10, 5), ("sell", 15, 6), ("buy", 5, 4)])).orderBy("ts").collect()
    assert [r.position for r in got] == [10.0, -5.0, 0.0]
    assert [r.average_price for r in got] == [5.0, 6.0, 0.0]
    assert [r.realized for r in got] == [0.0, 10.0, 10.0]


def fifo_loop(rows):
    lots, out = [], {}
    for i, (side, volume, price) in enumerate(rows):
        if side == "buy":
            lots.append([volume, price])
            continue
        gain = 0.0
        while volume > 0 and lots:
            take = min(volume, lots[0][0])
            gain += take * (price - lots[0][1])
            volume -= take
            lots[0][0] -= take
            if lots[0][0] == 0:
                lots.pop(0)
            out[i] = gain
    return out


def cost_loop(rows):
    q = avg = total = 0.0
    out = []
    for side, volume, price in rows:
        d = volume if side == "buy" else -volume
        if q * d >= 0:
            avg = (abs(q) * avg + abs(d) * price) / (abs(q) + abs(d))
        else:
            closing = min(abs(q), abs(d))
            total += closing * (price - avg) * (1 if q > 0 else -1)
            if abs(d) > abs(q):
                avg = price
        q += d
        if q == 0:
            avg = 0.0
        out.append((q, avg, total))
    return out


def test_random_tapes_equal_loops(spark):
    rng = random.Random(3)
    tapes = {
        f"t{k}": [(rng.choice(["buy", "sell"]), rng.randint(1, 9), rng.randint(90, 110)) for _ in range(rng.randint(1, 60))] for k in range(40)
    }
    df = spark.createDataFrame(
        [Row(symbol=n, ts=i, seq=i, side=s, volume=float(v), price=float(p)) for n, rows in tapes.items() for i, (s, v, p) in enumerate(rows)]
    )
    for rows_per_task in (None, 25):
        fifo = {}
        for r in pnl.fifo_pnl(df, rows_per_task=rows_per_task).collect():
            fifo.setdefault(r.symbol, {})[r.ts] = r.pnl
        costs = {}
        for r in pnl.average_cost(df, rows_per_task=rows_per_task).orderBy("symbol", "ts").collect():
            costs.setdefault(r.symbol, []).append((r.position, r.average_price, r.realized_pnl))
        for name, rows in tapes.items():
            assert fifo.get(name, {}) == pytest.approx(fifo_loop(rows))
            for got, want in zip(costs[name], cost_loop(rows), strict=True):
                assert got == pytest.approx(want, abs=1e-6)


def test_drawdown_series(spark):
    values = [100, 110, 120, 115, 112, 130, 90, 95, 140]
    df = spark.createDataFrame([Row(symbol="A", s=i, seq=i, value=float(v)) for i, v in enumerate(values)])
    d = one(risk.drawdown(df.withColumn("ts", F.timestamp_seconds("s"))))
    assert d.max_drawdown_money == 40.0 and d.max_drawdown == pytest.approx(40 / 130)
    assert (d.trough_ts - d.peak_ts).total_seconds() == 1.0


def test_drawdown_without_positive_peak(spark):
    df = spark.createDataFrame([Row(symbol="A", s=i, seq=i, value=float(v)) for i, v in enumerate([-5, -7])])
    assert one(risk.drawdown(df.withColumn("ts", F.timestamp_seconds("s")))).max_drawdown is None


def test_sharpe_of_portfolio_path(spark):
    path = [100000, 100500, 100250, 101000, 100800, 102000]
    df = spark.createDataFrame([Row(symbol="P", ts=i, seq=i, value=float(v)) for i, v in enumerate(path)])
    r = risk.with_returns(df, "value")
    rets = [b / a - 1 for a, b in zip(path, path[1:])]
    mean = sum(rets) / 5
    sample = (sum((x - mean) ** 2 for x in rets) / 4) ** 0.5
    assert one(risk.sharpe(r)).sharpe == pytest.approx(mean / sample * 252**0.5)
    population = (sum((x - mean) ** 2 for x in rets) / 5) ** 0.5
    assert one(risk.sharpe(r, population=True)).sharpe == pytest.approx(mean / population * 252**0.5)


def test_bootstrap_equals_brute_force(spark):
    pnls = [1.0, -2.0, 3.0, -4.0, 0.5]
    days = spark.createDataFrame([Row(bar=i, pnl=p) for i, p in enumerate(pnls)])
    got = one(risk.var_bootstrap(days, draws=200, horizon=3, seed=5))

    def mixed(x, key, p=2_147_483_647):
        z = (x % p * 48_271 + key) % p
        for s in (16_807, 39_373, 69_621):
            z = (z * z + z * s + key) % p
        return z

    sums, used = {}, [0] * 5
    for i in range(600):
        used[mixed(i, 5) % 5] += 1
        sums[i // 3] = sums.get(i // 3, 0.0) + pnls[mixed(i, 5) % 5]
    assert min(used) > 80
    ordered = sorted(sums.values())
    at = 0.05 * 199
    cut = ordered[int(at)] + (at - int(at)) * (ordered[int(at) + 1] - ordered[int(at)])
    assert got.draws == 200 and got["var"] == pytest.approx(-cut)
    tail = [x for x in ordered if x <= cut]
    assert got.expected_shortfall == pytest.approx(-sum(tail) / len(tail))


def test_option_values(spark):
    rows = [("call", 100.0, 100.0, 1.0, 0.05, 0.2), ("put", 100.0, 100.0, 1.0, 0.05, 0.2), ("call", 110.0, 100.0, 0.0, 0.05, 0.2)]
    df = spark.createDataFrame(rows, "kind string, spot double, strike double, years double, rate double, volatility double")
    c, p, x = options.price_chain(df).collect()
    assert c.value == pytest.approx(10.4506, abs=1e-4) and p.value == pytest.approx(5.5735, abs=1e-4)
    assert c.value - p.value == pytest.approx(100 - 100 * 2.718281828459045**-0.05)
    assert c.delta == pytest.approx(0.6368, abs=1e-4) and p.delta == pytest.approx(c.delta - 1)
    assert c.gamma == pytest.approx(0.018762, abs=1e-5) and c.vega == pytest.approx(0.37524, abs=1e-4)
    assert c.theta == pytest.approx(-0.01757, abs=1e-4) and c.rho == pytest.approx(0.53232, abs=1e-4)
    assert x.value == 10.0 and x.delta == 0.0 and x.time_value == 0.0


def test_quote_plan_rounds_to_tick(spark):
    df = spark.createDataFrame(
        [Row(bid=99.98, ask=100.02, bid_volume=300.0, ask_volume=400.0, fair_value=100.0, volatility=0.0, adverse=False, inventory=0.0)]
    )
    r = one(signals.quote_plan(df))
    assert r.quote_bid == pytest.approx(99.96) or r.quote_bid == pytest.approx(99.97)
    assert r.bid_size == 100.0 and r.ask_size == 100.0


def test_scalars(spark):
    df = spark.createDataFrame([Row(x=2.5, t="1704101400", s="btc/usd")])
    r = one(df.select(
        scalars.round_to_tick("x", 1.0).alias("even"), scalars.epoch_time(F.col("t").cast("long")).alias("s"),
        scalars.epoch_time(F.lit(1704101400123456789)).alias("ns"), scalars.symbol_code("s").alias("sym"),
        scalars.format_duration(F.lit(0.0025)).alias("d"), scalars.format_large(F.lit(2.5e9)).alias("b"),
    ))
    assert r.even == 2.0 and r.sym == "BTCUSD" and r.d == "2.5ms" and r.b == "2.5B"
    assert r.s.isoformat() == "2024-01-01T09:30:00" and r.ns.microsecond == 123456


def test_unknown_message_types_pass(spark):
    df = spark.createDataFrame([('{"type":"other"}',), ('{"type":"execution"}',), ("{}",)], "m string")
    assert [r[0] for r in df.select(checks.valid_message("m")).collect()] == [True, False, False]


def test_generated_ticks_repeat(spark):
    plan = spark.createDataFrame([("A", 500, 100.0)], "symbol string, rows long, start_price double")
    a, b = generate_ticks(plan), generate_ticks(plan.repartition(3), rows_per_task=50)
    same(a, b)
    r = one(a.agg(F.min(F.col("ask") - F.col("bid")).alias("s"), F.min("price").alias("p"), F.count("*").alias("n")))
    assert r.n == 500 and r.p > 0 and r.s == pytest.approx(0.015, abs=0.006)


def test_add_may_not_drop_columns_silently(spark):
    df = tape(spark, TAPE)
    assert "side" in windowed(df, lambda d, w: d.withColumn("x", F.lag("price").over(w)), back=1).columns
