"""Order-book tables.

Levels are rows (symbol, ts, side, price, volume, orders); a book is two sorted
arrays cut at a depth.  Depth cuts are rank filters, which Spark applies inside
each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio, safe_divide
from tickloom.operators.cleaning import keep_last
from tickloom.plans.merging import asof_join
from tickloom.plans.series import running

BOOK = ("symbol", "ts")


def _is_bid() -> Column:
    return F.col("side").isin("bid", "buy")


def ranked_levels(df: DataFrame, depth: int, keys: Sequence[str] = BOOK, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """The best ``depth`` rows of each side with their rank; equal prices stay separate rows."""
    side = F.when(_is_bid(), "bid").otherwise("ask")
    best_first = F.when(_is_bid(), -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy("_best", *tie)
    return (
        df.filter(F.col("side").isin("bid", "buy", "ask", "sell"))
        .withColumn("_best", best_first).withColumn("side", side)
        .withColumn("level", F.row_number().over(w)).filter(F.col("level") <= depth).drop("_best")
    )


def snapshots(df: DataFrame, depth: int = 10, keys: Sequence[str] = BOOK, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Wide snapshot per group: prices and volumes per level, mid, spread, totals of the kept levels."""
    def at(side: str, level: int, value: str) -> Column:
        hit = (F.col("side") == side) & (F.col("level") == level)
        return F.max(F.when(hit, F.col(value))).alias(f"{side}_{value}_{level}")

    cols = [at(s, i, v) for s in ("bid", "ask") for i in range(1, depth + 1) for v in ("price", "volume")]
    totals = [
        F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0.0)).alias(f"total_{s}_volume") for s in ("bid", "ask")
    ]
    wide = ranked_levels(df, depth, keys, tie).groupBy(*keys).agg(*cols, *totals)
    b, a = F.col("bid_price_1"), F.col("ask_price_1")
    return wide.withColumns({"mid_price": (a + b) / 2, "spread": a - b})


def to_books(df: DataFrame, depth: int = 20, keys: Sequence[str] = BOOK, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Books as sorted arrays ``bids`` (best first) and ``asks``; at most ``depth`` levels a side."""
    level = F.struct("level", "price", "volume", F.lit(1).alias("orders"))

    def side(name: str) -> Column:
        got = F.array_sort(F.collect_list(F.when(F.col("side") == name, level)))
        return F.transform(got, lambda x: F.struct(x["price"].alias("price"), x["volume"].alias("volume"), x["orders"].alias("orders")))

    return ranked_levels(df, depth, keys, tie).groupBy(*keys).agg(side("bid").alias("bids"), side("ask").alias("asks"))


def _total(levels: str) -> Column:
    return F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + x["volume"])


def quote_metrics(books: DataFrame) -> DataFrame:
    """Best quotes, mid, spread, totals, imbalance, microprice, crossed and locked flags; null when a side is empty."""
    bid, ask = F.try_element_at("bids", F.lit(1)), F.try_element_at("asks", F.lit(1))
    out = books.withColumns(
        {
            "best_bid": bid["price"], "best_bid_volume": bid["volume"], "best_ask": ask["price"],
            "best_ask_volume": ask["volume"], "total_bid_volume": _total("bids"), "total_ask_volume": _total("asks"),
        }
    )
    b, a = F.col("best_bid"), F.col("best_ask")
    tb, ta = F.col("total_bid_volume"), F.col("total_ask_volume")
    return out.withColumns(
        {
            "mid_price": (b + a) / 2, "spread": a - b, "spread_bps": ratio(a - b, (b + a) / 2) * 10000,
            "imbalance": ratio(tb - ta, tb + ta), "is_crossed": F.coalesce(b >= a, F.lit(False)),
            "is_locked": F.coalesce(F.abs(b - a) < 1e-8, F.lit(False)),
        }
    )


def microprice(alpha: float | None = None, bid="best_bid", ask="best_ask", bid_volume="best_bid_volume", ask_volume="best_ask_volume") -> Column:
    """Size-weighted price; with ``alpha`` the two terms are weighted alpha and 1 - alpha (0.5 halves the price)."""
    b, a, bv, av = F.col(bid), F.col(ask), F.col(bid_volume), F.col(ask_volume)
    up, down = (F.lit(alpha), F.lit(1.0 - alpha)) if alpha is not None else (F.lit(1.0), F.lit(1.0))
    return ratio(up * a * bv + down * b * av, bv + av)


def best_quote_ffill(df: DataFrame, tick: float = 0.01, rows_per_task: int | None = None) -> DataFrame:
    """Best bid and ask per timestamp, carried forward, on every tick row."""
    best = df.groupBy("symbol", "ts").agg(
        F.max(F.when(_is_bid(), F.col("price"))).alias("_b"),
        F.min(F.when(F.col("side").isin("ask", "sell"), F.col("price"))).alias("_a"),
    )
    carried = running(
        best, {"best_bid": ("last", F.col("_b")), "best_ask": ("last", F.col("_a"))}, order=("ts",), rows_per_task=rows_per_task
    ).drop("_b", "_a")
    b, a = F.col("best_bid"), F.col("best_ask")
    out = df.join(carried, ["symbol", "ts"]).withColumns({"mid_price": (b + a) / 2, "spread": a - b})
    vs_mid = F.col("price") - F.col("mid_price")
    return out.withColumns(
        {
            "spread_pct": safe_divide("spread", "mid_price") * 100, "spread_ticks": F.col("spread") / F.lit(tick),
            "price_vs_mid": vs_mid, "price_vs_mid_pct": safe_divide(vs_mid, "mid_price") * 100,
        }
    )


def depth_levels(books: DataFrame, side: str, n: int) -> DataFrame:
    """First ``n`` levels of a side as rows."""
    return books.select(*BOOK, F.posexplode(F.slice(side, 1, n)).alias("_p", "_l")).select(
        *BOOK, (F.col("_p") + 1).alias("level"), F.col("_l.price").alias("price"), F.col("_l.volume").alias("volume")
    )


def volume_at_price(levels: DataFrame, price: Column, tick: float = 0.01, keys: Sequence[str] = BOOK) -> DataFrame:
    """Volume per group and side at a price (compared in whole ticks); 0 where there is none."""
    same = F.round(F.col("price") / F.lit(tick)) == F.round(price / F.lit(tick))
    return levels.groupBy(*keys, "side").agg(F.sum(F.when(same, F.col("volume")).otherwise(0.0)).alias("volume"))


def market_impact(levels: DataFrame, size: Column, keys: Sequence[str] = BOOK, tie: Sequence[str] = ("seq",), rows_per_task: int | None = None) -> DataFrame:
    """Average price and cost of taking ``size`` from each side; a shortage is priced at the last level."""
    side = F.when(_is_bid(), "bid").otherwise("ask")
    walk = levels.withColumn("side", side).withColumn("_best", F.when(side == "bid", -F.col("price")).otherwise(F.col("price")))
    group = (*keys, "side")
    walked = running(walk, {"_upto": ("sum", F.col("volume"))}, keys=group, order=("_best", *tie), rows_per_task=rows_per_task)
    before = F.col("_upto") - F.col("volume")
    taken = F.least(F.col("volume"), F.greatest(size - before, F.lit(0.0)))
    out = walked.withColumn("_take", taken).groupBy(*group).agg(
        F.sum(F.col("_take") * F.col("price")).alias("_cost"), F.sum("_take").alias("_took"),
        F.max("_best").alias("_last"), F.first(size).alias("_size"),
    )
    last = F.when(F.col("side") == "bid", -F.col("_last")).otherwise(F.col("_last"))
    total = F.col("_cost") + (F.col("_size") - F.col("_took")) * last
    return out.select(*group, safe_divide(total, "_size").alias("average_price"), total.alias("total_cost"))


def effective_spread(trades: DataFrame, quotes: DataFrame, **series) -> DataFrame:
    """2 * |trade price - mid| with the latest quote at or before the trade."""
    mids = quotes.select("symbol", "ts", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("mid_price"))
    joined = asof_join(trades, mids, **series)
    return joined.withColumn("effective_spread", 2 * F.abs(F.col("price") - F.col("mid_price")))


def l2_state(deltas: DataFrame, depth: int = 20, until: Column | None = None) -> DataFrame:
    """Book at a time from depth changes: last quantity per price, 0 removes, best ``depth`` a side."""
    seen = deltas if until is None else deltas.filter(F.col("ts") <= until)
    last = seen.groupBy("symbol", "side", "price").agg(F.max_by("qty", "seq").alias("volume"))
    return ranked_levels(last.filter("volume > 0"), depth, keys=("symbol",), tie=())


def l3_levels(updates: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Levels from order updates: the last update per order, cancelled ones dropped."""
    live = keep_last(updates, keys=("order_id",), tie=order).filter(F.col("action") != "cancel")
    return live.groupBy("symbol", "side", "price").agg(F.sum("volume").alias("volume"), F.count("*").alias("orders"))


def ladder(levels: DataFrame, n: int, keys: Sequence[str] = BOOK, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Level rows with their distance from the mid."""
    top = ranked_levels(levels, n, keys, tie)
    best = top.filter("level = 1").groupBy(*keys).agg(
        ((F.max(F.when(F.col("side") == "bid", F.col("price"))) + F.max(F.when(F.col("side") == "ask", F.col("price")))) / 2).alias("mid_price")
    )
    return top.join(best, list(keys)).withColumn("distance", F.col("price") - F.col("mid_price"))


def diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-8, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Compare two sets of levels (key, side, price, volume, orders): one row of match flags per key."""
    join = [*keys, "side", "price"]
    both = a.select(*join, F.col("volume").alias("va"), F.col("orders").alias("oa")).join(
        b.select(*join, F.col("volume").alias("vb"), F.col("orders").alias("ob")), join, "full_outer"
    )
    bid = F.col("side") == "bid"

    def top(v: str, which: Column, pick, score: Column) -> Column:
        at = F.when(which & F.col(v).isNotNull(), score)
        return pick(F.col("price"), at)

    def count(v: str, which: Column) -> Column:
        return F.count_if(which & F.col(v).isNotNull())

    agg = both.groupBy(*keys).agg(
        *[top(v, bid, F.max_by, F.col("price")).alias(f"_bid_{v}") for v in ("va", "vb")],
        *[top(v, ~bid, F.min_by, F.col("price")).alias(f"_ask_{v}") for v in ("va", "vb")],
        *[F.max_by(v, F.when(bid & F.col(v).isNotNull(), F.col("price"))).alias(f"_bv_{v}") for v in ("va", "vb")],
        *[F.min_by(v, F.when(~bid & F.col(v).isNotNull(), F.col("price"))).alias(f"_av_{v}") for v in ("va", "vb")],
        *[count(v, bid).alias(f"_nb_{v}") for v in ("va", "vb")], *[count(v, ~bid).alias(f"_na_{v}") for v in ("va", "vb")],
        F.sum("oa").alias("_oa"), F.sum("ob").alias("_ob"),
    )

    def near(x: str) -> Column:
        return F.abs(F.coalesce(f"_{x}_va", F.lit(0.0)) - F.coalesce(f"_{x}_vb", F.lit(0.0))) < tolerance

    out = agg.select(
        *keys, near("bid").alias("best_bid_match"), near("ask").alias("best_ask_match"),
        F.col("_bv_va").eqNullSafe(F.col("_bv_vb")).alias("bid_volume_match"),
        F.col("_av_va").eqNullSafe(F.col("_av_vb")).alias("ask_volume_match"),
        F.col("_oa").eqNullSafe(F.col("_ob")).alias("order_count_match"),
        (F.col("_nb_va") == F.col("_nb_vb")).alias("bid_levels_match"), (F.col("_na_va") == F.col("_na_vb")).alias("ask_levels_match"),
    )
    every = F.lit(True)
    for c in out.columns[len(keys):]:
        every = every & F.col(c)
    return out.withColumn("identical", every)


def book_stats(levels: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Level counts, totals and orders per side, crossed and empty flags."""
    bid = _is_bid()
    best_bid, best_ask = F.max(F.when(bid, F.col("price"))), F.min(F.when(~bid, F.col("price")))
    return levels.groupBy(*keys).agg(
        F.count_if(bid).alias("bid_levels"), F.count_if(~bid).alias("ask_levels"),
        F.sum(F.when(bid, F.col("volume")).otherwise(0.0)).alias("total_bid_volume"),
        F.sum(F.when(~bid, F.col("volume")).otherwise(0.0)).alias("total_ask_volume"),
        F.count("*").alias("orders"), F.coalesce(best_bid >= best_ask, F.lit(False)).alias("is_crossed"),
        (best_bid.isNull() | best_ask.isNull()).alias("is_empty_side"),
    )


def recent(df: DataFrame, n: int, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last ``n`` rows per key, newest first in ``rank``; cut inside each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


