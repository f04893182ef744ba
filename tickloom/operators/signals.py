"""Signal tables: one row per symbol and tick, as window and column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalars import clip, ratio, round_to_tick
from tickloom.operators.features import Feature, compute, full, trailing
from tickloom.plans.frontier import only_contenders
from tickloom.plans.pairs import centred_moments, deviations
from tickloom.plans.series import broadcast_if_small, time_cells, windowed
from tickloom.plans.sweep import by_groups, live_sums

# Weights of the signal kinds in the combined signal.
KIND_WEIGHTS = {"momentum": 0.25, "mean_reversion": 0.20, "order_flow": 0.30, "microstructure": 0.15, "technical": 0.10}
DECAY_PER_SECOND, MAX_AGE_SECONDS, KEEP_ABOVE = 0.95, 5.0, 0.1


def c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Kind:
    """One kind of signal: columns added over the window of a symbol, and what makes a row a signal."""

    name: str
    add: Callable[[DataFrame, WindowSpec], DataFrame]
    keep: Column
    strength: Column
    confidence: Column
    horizon_ms: int
    back: int = 0
    extra: tuple[str, ...] = ()


def _of_kind(df: DataFrame, kind: Kind, **series) -> DataFrame:
    """Rows that are a signal of the kind: symbol, ts, seq, kind, strength, confidence, horizon_ms and the kind's extra columns."""
    d = windowed(df, kind.add, back=kind.back, **series) if kind.back else kind.add(df, None)
    return d.filter(F.coalesce(kind.keep, F.lit(False))).select(
        "symbol", "ts", "seq", F.lit(kind.name).alias("kind"), kind.strength.alias("strength"), kind.confidence.alias("confidence"),
        F.lit(kind.horizon_ms).alias("horizon_ms"), *kind.extra,
    )


def _momentum(n: int) -> Kind:
    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns(
            {
                "short": F.coalesce(ratio("price", F.lag("price", n // 2).over(w)) - 1, F.lit(0.0)),
                "long": F.coalesce(ratio("price", F.lag("price", n).over(w)) - 1, F.lit(0.0)),
                "_step": F.signum(c("price") - F.lag("price").over(w)),
                "_seen": F.count("*").over(trailing(w, n)),
            }
        )
        steps = trailing(w, n - 1)
        return d.withColumns({"_up": F.count_if(c("_step") == 1).over(steps), "_down": F.count_if(c("_step") == -1).over(steps)})

    m = c("short") * 0.7 + c("long") * 0.3
    same = F.when(m > 0, c("_up")).otherwise(c("_down")) / (n - 1)
    return Kind("momentum", add, (c("_seen") >= n) & (F.abs(m) > 0.001), clip(m * 10, -1.0, 1.0), same, n * 100, n + 1, ("short", "long"))


def _mean_reversion(n: int) -> Kind:
    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({"_mean": full(F.avg, "price", n, w), "_sd": full(F.stddev_pop, "price", n, w)})

    m = ratio(c("_mean") - c("price"), "_mean")
    confidence = F.least(F.lit(1.0), ratio("_sd", "_mean") * 20)
    return Kind("mean_reversion", add, F.abs(m) > 0.005, clip(m * 5, -1.0, 1.0), confidence, n * 50, n)


def _order_flow() -> Kind:
    total = c("bid_volume") + c("ask_volume")
    imbalance = ratio(c("bid_volume") - c("ask_volume"), total)
    return Kind("order_flow", lambda d, w: d, F.abs(imbalance) > 0.2, imbalance * 0.8, F.least(F.lit(1.0), total / 10000), 1000)


def _microstructure(n: int) -> Kind:
    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        # The mean needs n snapshots; the current one is among them.
        d = d.withColumn("spread_pct", ratio(c("ask") - c("bid"), (c("ask") + c("bid")) / 2))
        return d.withColumn("_spread_mean", full(F.avg, "spread_pct", n, w))

    dev = ratio(c("spread_pct") - c("_spread_mean"), "_spread_mean")
    return Kind(
        "microstructure", add, F.abs(dev) > 0.3, clip(dev * -0.5, -1.0, 1.0), F.least(F.lit(1.0), F.abs(dev)), 2000, n, ("spread_pct",)
    )


def _technical(least: int) -> Kind:
    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns(
            {
                "_s": F.avg("price").over(trailing(w, 10)), "_l": F.avg("price").over(trailing(w, 20)),
                "_n": F.count("*").over(trailing(w, least)),
            }
        )

    a, b, m = ratio(c("price") - c("_s"), "_s"), ratio(c("price") - c("_l"), "_l"), ratio(c("_s") - c("_l"), "_l")
    strength = a * 0.4 + b * 0.3 + m * 0.3
    aligned = (F.signum(a) == F.signum(b)) & (F.signum(b) == F.signum(m))
    confidence = F.when(aligned, 0.8).otherwise(0.4)
    return Kind("technical", add, (c("_n") >= least) & (F.abs(strength) > 0.01), clip(strength * 5, -1.0, 1.0), confidence, 3000, least)


def momentum(df: DataFrame, n: int = 10, **series) -> DataFrame:
    """0.7 short + 0.3 long momentum; confidence is the share of price steps of the same sign."""
    return _of_kind(df, _momentum(n), **series)


def mean_reversion(df: DataFrame, n: int = 20, **series) -> DataFrame:
    return _of_kind(df, _mean_reversion(n), **series)


def order_flow(quotes: DataFrame) -> DataFrame:
    return _of_kind(quotes, _order_flow())


def microstructure(quotes: DataFrame, n: int = 10, **series) -> DataFrame:
    """Relative spread against its mean over the last ``n`` quotes."""
    return _of_kind(quotes, _microstructure(n), **series)


def technical(df: DataFrame, least: int = 50, **series) -> DataFrame:
    return _of_kind(df, _technical(least), **series)


def all_kinds(quotes: DataFrame, **series) -> DataFrame:
    """Signals of all five kinds from one pass over the rows: symbol, ts, seq, kind, strength, confidence, horizon_ms."""
    kinds = (_momentum(10), _mean_reversion(20), _order_flow(), _microstructure(10), _technical(50))

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        return reduce(lambda done, kind: kind.add(done, w), kinds, d)

    d = windowed(quotes, add, back=max(k.back for k in kinds), **series)
    rows = [
        F.when(
            F.coalesce(k.keep, F.lit(False)),
            F.struct(
                F.lit(k.name).alias("kind"), k.strength.cast("double").alias("strength"), k.confidence.cast("double").alias("confidence"),
                F.lit(k.horizon_ms).alias("horizon_ms"),
            ),
        )
        for k in kinds
    ]
    return d.select("symbol", "ts", "seq", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("symbol", "ts", "seq", "s.*")


def performance(signals: DataFrame, acted: Column, keys: Sequence[str] = ("kind",)) -> DataFrame:
    """Per kind: signals, mean strength, mean size of the strength, mean confidence, and the share of signals acted on."""
    return signals.groupBy(*keys).agg(
        F.count("*").alias("signals"), F.avg("strength").alias("mean_strength"), F.avg(F.abs("strength")).alias("mean_size"),
        F.avg("confidence").alias("mean_confidence"), F.avg(F.coalesce(acted, F.lit(False)).cast("int")).alias("acted_share"),
    )


def combine(
    signals: DataFrame, seconds: float = MAX_AGE_SECONDS, decay: float = DECAY_PER_SECOND, cell_seconds: float = 3600.0,
    weights: Mapping[str, float] = KIND_WEIGHTS, rows_per_task: int | None = None,
) -> DataFrame:
    """Combined signal at each signal time from those of the last seconds.

    Strength and confidence decay once, by age; what has decayed too far is left
    out.  Cells of the time axis are swept, so that a burst of signals costs no
    more a signal than a quiet hour.
    """
    kind_weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), c("kind")), F.lit(0.1))
    rate = math.log(decay) / 1e6  # a microsecond
    if rate < 0:
        # Values grow by the age of the cell inside it; they stay far from the largest double.
        cell_seconds = min(cell_seconds, 300 / (-2e6 * rate))
    rows = signals.where("strength IS NOT NULL AND confidence IS NOT NULL AND ts IS NOT NULL").select(
        "symbol", c("ts").cast("timestamp").alias("ts"), c("strength").cast("double").alias("s"), c("confidence").cast("double").alias("k"), kind_weight.alias("w")
    )
    cells = time_cells(rows, seconds_back=seconds, cell_seconds=cell_seconds, rows_per_task=rows_per_task).drop("ts")
    horizon = int(seconds * 1e6)

    def lasts(value: np.ndarray) -> np.ndarray:
        """Microseconds for which a value stays above the least one that counts."""
        with np.errstate(divide="ignore"):
            room = np.log(np.maximum(value, 0.0) / KEEP_ABOVE)
        if rate == 0:
            return np.where(room > 0, horizon, 0)
        return np.clip(np.ceil(room / -rate), 0, horizon).astype(np.int64)

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        us, home, cell = (table.column(x).to_numpy() for x in ("_us", "__home", "__at"))
        s, k, w = (table.column(x).to_numpy() for x in "skw")
        leave = us + np.minimum(np.minimum(lasts(np.abs(s)), lasts(k)), horizon)
        at, live, (total, sums), best = live_sums(group, us, leave, [w * k, w * k * s], [rate, 2 * rate], k, rate)
        shown = (home[at] == cell[at]) & (live > 0)
        at, live, total, sums, best = at[shown], live[shown], total[shown], sums[shown], best[shown]
        combined = np.divide(sums, total, out=np.full(len(at), np.nan), where=total != 0)
        return pa.table({
            "symbol": table.column("symbol").take(pa.array(at)), "us": us[at], "components": live.astype(np.int32), "total_weight": total,
            "combined": pa.array(combined, from_pandas=True), "combined_confidence": best * np.minimum(1.0, total / 0.5),
        })

    out = by_groups(cells, ["symbol", "__at"], ["_us"], run, "symbol string, us long, components int, total_weight double, combined double, combined_confidence double")
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "components", "total_weight", "combined", "combined_confidence")


def combine_values(df: DataFrame, keys: Sequence[str], method: str = "weighted_average") -> DataFrame:
    """Combine (strength, weight) rows per key: weighted average, median or strongest."""
    if method == "weighted_average":
        agg = F.coalesce(ratio(F.sum(c("strength") * c("weight")), F.sum("weight")), F.lit(0.0))
    elif method == "median":
        agg = F.percentile("strength", F.lit(0.5))
    elif method == "max_abs":
        agg = F.max_by("strength", F.struct(F.abs("strength"), c("strength")))
    else:
        raise ValueError(f"unknown method {method}")
    return df.groupBy(*keys).agg(agg.alias("combined"))


def ma_cross(df: DataFrame, short: int = 10, long: int = 30, **series) -> DataFrame:
    """Crossings of two moving averages."""

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"short_ma": F.avg("price").over(trailing(w, short)), "long_ma": full(F.avg, "price", long, w)})
        return d.withColumns({"_ps": F.lag("short_ma").over(w), "_pl": F.lag("long_ma").over(w)})

    d = windowed(df, add, back=long + 1, **series)
    action = F.when((c("_ps") <= c("_pl")) & (c("short_ma") > c("long_ma")), "buy").when(
        (c("_ps") >= c("_pl")) & (c("short_ma") < c("long_ma")), "sell"
    )
    return d.withColumn("action", action).filter(c("action").isNotNull()).drop("_ps", "_pl").withColumn("confidence", F.lit(0.7))


def size_filter(
    signals: DataFrame, positions: DataFrame, capital: float = 100_000.0, risk: float = 0.02, max_size: int = 1000,
    max_exposure: float = 10_000.0, offset: float = 0.01,
) -> DataFrame:
    """Size a signal by capital at risk, drop it beyond the exposure limit, quote it a step off the price."""
    volume = F.least(F.floor(F.lit(capital * risk) / c("price")), F.lit(max_size))
    buy = c("action") == "buy"
    held = F.coalesce("qty", F.lit(0.0))
    after = held + F.when(buy, c("order_volume")).otherwise(-c("order_volume"))
    return (
        signals.filter("price > 0").withColumn("order_volume", volume)
        .join(broadcast_if_small(positions.select("symbol", "qty")), "symbol", "left")
        .filter(F.abs(after) <= max_exposure)
        .withColumn("limit_price", F.when(buy, c("price") - F.lit(offset)).otherwise(c("price") + F.lit(offset)))
        .drop("qty")
    )


def fair_value(quotes: DataFrame) -> DataFrame:
    """0.4 mid, 0.5 microprice, 0.1 recent VWAP, over those present (columns bid.., vwap)."""
    mid = (c("bid") + c("ask")) / 2
    micro = ratio(c("bid") * c("ask_volume") + c("ask") * c("bid_volume"), c("bid_volume") + c("ask_volume"))
    parts = [(mid, 0.4), (micro, 0.5), (c("vwap"), 0.1)]
    total = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    value = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    count = sum((v.isNotNull().cast("int") for v, _ in parts), F.lit(0))
    return quotes.withColumns({"fair_value": ratio(value, total), "fair_value_confidence": F.least(F.lit(1.0), count / 3.0)})


def quote_plan(
    quotes: DataFrame, *, min_spread: float = 0.01, max_spread: float = 0.5, target_spread: float = 0.02, min_spread_bps: float = 1.0,
    max_inventory: float = 1000.0, base_size: int = 100, max_size: int = 500, skew: float = 0.1, tick: float = 0.01,
) -> DataFrame:
    """Planned spread, prices and sizes from quote, fair_value, volatility, adverse flag and inventory."""
    mid, market = (c("bid") + c("ask")) / 2, c("ask") - c("bid")
    pressure = F.greatest(F.lit(0.0), 1 - ratio(market, mid) * 10000 / 20)
    held = c("inventory") / F.lit(max_inventory)
    raw = F.greatest(F.lit(target_spread), mid * F.lit(min_spread_bps / 10000))
    raw = raw * (1 + F.coalesce("volatility", F.lit(0.0)) * 2) * (1 - F.coalesce(pressure, F.lit(0.0)) * 0.3) * (1 + F.abs(held) * 0.5)
    raw = raw * F.when(c("adverse"), 1.5).otherwise(1.0)
    d = quotes.withColumn("planned_spread", F.least(F.lit(max_spread), F.greatest(F.lit(min_spread), raw)))
    s = c("planned_spread")
    lean = held * F.lit(skew) * s / 2
    bid = F.greatest(F.least(c("fair_value") - s / 2 - lean, c("bid") - 0.01), c("bid") - s * 2)
    ask = F.least(F.greatest(c("fair_value") + s / 2 - lean, c("ask") + 0.01), c("ask") + s * 2)

    def size(lean_: Column, liquidity: Column, room: Column) -> Column:
        want = F.floor(F.lit(float(base_size)) * (1 + lean_))
        capped = F.least(want, F.least(F.lit(max_size), F.floor(liquidity / 2)))
        return F.greatest(F.lit(0.0), F.least(F.greatest(capped, F.lit(1)).cast("double"), room))

    return d.withColumns(
        {
            "quote_bid": round_to_tick(bid, tick), "quote_ask": round_to_tick(ask, tick),
            "bid_size": size(-held * 0.5, c("ask_volume"), F.lit(max_inventory) - c("inventory")),
            "ask_size": size(held * 0.5, c("bid_volume"), F.lit(max_inventory) + c("inventory")),
        }
    )


def adverse_selection(df: DataFrame, **series) -> DataFrame:
    """Move of more than 0.05 % over the last three trades."""
    move = lambda w: F.coalesce(F.abs(ratio(c("price") - F.lag("price", 2).over(w), F.lag("price", 2).over(w))) > 0.0005, F.lit(False))
    return compute(df, [Feature("adverse", move, back=2)], **series)


def pair_spread_z(pair: DataFrame, n: int = 100, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, **series) -> DataFrame:
    """Hedge ratio, spread and z-score of price_a on price_b over the last ``n`` common rows.

    The spread of the whole window uses the current ratio h, so its mean and
    deviation follow from the moments: var(a) - 2h cov(a, b) + h^2 var(b).
    """
    def moment(agg) -> Column:
        return lambda w: F.when(F.count("*").over(trailing(w, n)) >= n, agg(trailing(w, n)))

    feats = [
        Feature("_ma", moment(lambda f: F.avg("price_a").over(f)), back=n),
        Feature("_mb", moment(lambda f: F.avg("price_b").over(f)), back=n),
        Feature("_va", moment(lambda f: F.var_pop("price_a").over(f)), back=n),
        Feature("_vb", moment(lambda f: F.var_pop("price_b").over(f)), back=n),
        Feature("_cab", moment(lambda f: F.covar_pop("price_a", "price_b").over(f)), back=n),
    ]
    d = compute(pair, feats, **series).withColumn("hedge_ratio", ratio("_cab", "_vb"))
    h = c("hedge_ratio")
    var = c("_va") - 2 * h * c("_cab") + h * h * c("_vb")
    d = d.withColumns(
        {
            "spread": c("price_a") - h * c("price_b"), "spread_mean": c("_ma") - h * c("_mb"),
            "spread_std": F.sqrt(F.greatest(var, F.lit(0.0))),
        }
    )
    z = F.when(c("spread_std") > 1e-12, (c("spread") - c("spread_mean")) / c("spread_std")).otherwise(
        F.when(c("spread_std").isNotNull(), F.lit(0.0))
    )
    d = d.withColumn("z", z)
    action = F.when(F.abs("z") > stop, "stop").when(c("z") > entry, "short_a_long_b").when(c("z") < -entry, "long_a_short_b").when(
        F.abs("z") < leave, "exit"
    )
    return d.withColumn("action", action).drop("_ma", "_mb", "_va", "_vb", "_cab")


def pair_discovery(bars: DataFrame, min_corr: float = 0.8, min_z: float = 2.0, least: int = 50, at: str = "bar", value: str = "price", **shape) -> DataFrame:
    """Correlated pairs whose current spread is far from its mean.

    Correlation, mean spread and the spread at the last common time all come from
    one pass of ``centred_moments``; no pair is matched row by row, and pairs that
    miss a bound by more than rounding stay in the tasks that multiply them.
    """
    n = c("n")
    vx, vy, cxy = deviations()

    def likely(s: dict[str, np.ndarray]) -> np.ndarray:
        # Said by what is not below: as in the filters here, NaN is above all numbers.
        with np.errstate(all="ignore"):
            x, y, xy = (s[p] - s[q] * s[r] / s["n"] for p, q, r in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
            if "last_gap" not in s:
                return ~(s["n"] < least) & ~(np.abs(xy) < min_corr * (1 - 1e-9) * np.sqrt(x * y))
            off = (s["last_gap"] + s["ca"] - s["cb"]) - ((s["sx"] - s["sy"]) / s["n"] + s["ca"] - s["cb"])
            noise = 1e-9 * (np.abs(s["last_gap"]) + np.abs(s["ca"]) + np.abs(s["cb"]))
            return ~(np.abs(off) + noise < min_z * (1 - 1e-6) * np.sqrt((x + y - 2 * xy) / (s["n"] - 1)))

    stats = centred_moments(bars, at=at, value=value, **{"keep": likely, **shape})
    rows = stats.withColumns({
        "corr": F.when((n > 1) & (vx > 0) & (vy > 0), cxy / F.sqrt(vx * vy)), "spread": c("last_gap") + c("ca") - c("cb"),
        "spread_mean": (c("sx") - c("sy")) / n + c("ca") - c("cb"), "spread_std": F.sqrt(F.greatest(vx + vy - 2 * cxy, F.lit(0.0)) / F.when(n > 1, n - 1)),
    })
    strong = rows.filter((n >= least) & (F.abs("corr") > min_corr)).select("a", "b", "n", "corr", "spread_mean", "spread_std", "last_at", "spread")
    z = ratio(c("spread") - c("spread_mean"), "spread_std")
    return (
        strong.withColumn("last_at", F.timestamp_micros("last_at")).withColumn("z", z).filter(F.abs("z") > min_z)
        .withColumns({"expected_profit": F.abs("z") * c("spread_std"), "confidence": F.least(F.abs("z") / min_z, F.lit(1.0))})
    )


def cross_venue_arb(prices: DataFrame, primary: str = "primary", threshold: float = 0.005) -> DataFrame:
    """Venue prices more than ``threshold`` off the primary price (columns venue, price, primary_price)."""
    share = ratio(F.abs(c("price") - c("primary_price")), "primary_price")
    dearer = c("price") > c("primary_price")
    return prices.withColumn("spread_pct", share).filter(c("spread_pct") > threshold).withColumns(
        {
            "buy_venue": F.when(dearer, F.lit(primary)).otherwise(c("venue")), "sell_venue": F.when(dearer, c("venue")).otherwise(F.lit(primary)),
            "buy_price": F.least("price", "primary_price"), "sell_price": F.greatest("price", "primary_price"),
            "profit_per_10k": c("spread_pct") * 10000,
        }
    )


def best_route(
    orders: DataFrame, venues: DataFrame, max_slippage: float = 0.01, primary_price: str = "primary_price", gas: float = 5.0, below_zero: bool | None = None
) -> DataFrame:
    """Cheapest venue per order: the primary market, or a pool of the symbol within the slippage cap.

    orders: order_key, symbol, volume, primary_price; venues: symbol, venue, venue_price, liquidity.
    Pools that no order can prefer go before they are shuffled or meet an order, so the candidate
    rows are orders x the few pools of a symbol that are cheap or deep.  ``below_zero``: some volume
    or primary price may be negative; looked up in the orders if not given.
    """
    v, pp = c("volume"), c(primary_price)
    types = dict(venues.dtypes)
    if max_slippage < 1:
        venues = venues.filter(c("liquidity") > 0)
    if types["venue_price"] == types["liquidity"] == "double" and types["venue"] == "string":
        if below_zero is None:
            below_zero = not orders.filter((v < 0) | (pp < 0)).isEmpty()
        venues = only_contenders(venues, gas, below_zero)
    slip = F.when(c("liquidity") > 0, F.least(F.lit(0.5), v * pp / (2 * c("liquidity")))).otherwise(F.lit(1.0))
    met = orders.join(broadcast_if_small(venues), "symbol").withColumn("slippage", slip).filter(c("slippage") <= max_slippage)
    cost = c("venue_price") * (1 + c("slippage")) + F.lit(gas)
    pool = F.struct(cost.alias("cost"), "venue", c("venue_price").alias("expected_price"), "slippage", F.lit(gas).alias("fee"))
    # The cheapest pool of an order, in each task first; the primary market is a column of the order.
    best = met.groupBy("order_key").agg(F.min(pool).alias("_pool"))
    off = F.lit(0.001) + F.least(F.lit(0.01), v / 100_000)
    main = F.struct(
        (pp * (1 + off)).alias("cost"), F.lit("primary").alias("venue"), pp.alias("expected_price"), off.alias("slippage"), F.lit(0.0).alias("fee")
    )
    out = orders.join(best, "order_key", "left").select("order_key", F.least(main, F.coalesce("_pool", main)).alias("_r"))
    return out.select("order_key", "_r.venue", "_r.expected_price", "_r.slippage", "_r.fee", "_r.cost")


def venue_fair_value(venues: DataFrame, primary: DataFrame, share: float = 0.7) -> DataFrame:
    """0.7 primary + 0.3 liquidity-weighted venue price, and the liquidity risk 1 / (1 + log10 L) capped at 1."""
    by = venues.groupBy("symbol").agg(
        F.coalesce(ratio(F.sum(c("venue_price") * c("liquidity")), F.sum("liquidity")), F.avg("venue_price")).alias("_v"),
        F.sum("liquidity").alias("_l"),
    )
    out = primary.join(by, "symbol", "left")
    risk = F.when(c("_l") > 0, F.coalesce(F.try_divide(F.lit(1.0), 1 + F.log10("_l")), F.lit(1.0))).otherwise(F.lit(1.0))
    return out.select(
        "symbol", F.when(c("_v").isNull(), c("primary_price")).otherwise(c("primary_price") * share + c("_v") * (1 - share)).alias("fair_value"),
        F.least(F.lit(1.0), risk).alias("liquidity_risk"),
    )
