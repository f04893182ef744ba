"""Tick, trade and book enrichment, routing and function chains."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.plans.series import placed, running, windowed

Transform = Callable[[DataFrame], DataFrame]
_ORDER = ("_new", "ts", "seq")


def enrich_batch(batch: DataFrame, carried: DataFrame | None, rows_per_task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Price change of ticks against the symbol's previous tick, and the side of trades against the last one.

    ``batch``: symbol, ts, seq, kind (tick or trade), price.  ``carried``: the
    last tick per symbol of all earlier batches, which counts as earlier than
    anything in the batch.  A first tick has no change; a trade before any tick
    keeps no side.
    """
    rows = batch.select("symbol", "ts", "seq", "kind", "price", F.lit(1).alias("_new"))
    if carried is not None:
        rows = rows.unionByName(carried.select("symbol", "ts", "seq", F.lit("tick").alias("kind"), "price", F.lit(0).alias("_new")))
    how = {"order": _ORDER, "rows_per_task": rows_per_task}
    tick = F.col("kind") == "tick"
    seen = running(placed(rows, **how), {"_last": ("last", F.when(tick, F.col("price")))}, **how)
    seen = windowed(seen, lambda d, w: d.withColumn("_before", F.lag("_last").over(w)), back=1, **how)
    change = F.when(tick, F.col("price") - F.col("_before"))
    side = F.when(~tick & F.col("_last").isNotNull(), F.when(F.col("price") >= F.col("_last"), "buy").otherwise("sell"))
    out = seen.filter("_new = 1").select(
        "symbol", "ts", "seq", "kind", "price", change.alias("price_change"),
        (ratio(change, "_before") * 100).alias("price_change_pct"), side.alias("side"),
    )
    at = F.struct(*_ORDER)
    after = rows.filter(tick).groupBy("symbol").agg(F.max_by(F.struct("ts", "seq", "price"), at).alias("_v")).select("symbol", "_v.*")
    return out, after


def enrich_books(events: DataFrame, data: str = "data") -> DataFrame:
    """Best bid and ask, mid and spread from JSON levels; events with an empty side are left out."""
    level = "array<struct<price:double,size:double>>"
    book = F.from_json(F.col(data), f"bids {level}, asks {level}")
    bid = F.array_max(F.transform(book["bids"], lambda x: x["price"]))
    ask = F.array_min(F.transform(book["asks"], lambda x: x["price"]))
    d = events.withColumns({"best_bid": bid, "best_ask": ask}).filter(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    spread = F.col("best_ask") - F.col("best_bid")
    return d.withColumns({"mid_price": mid, "spread": spread, "spread_pct": ratio(spread, mid) * 100})


def route_by_type(events: DataFrame, kinds: Sequence[str], column: str = "event_type") -> dict[str, DataFrame]:
    """One branch per known type plus ``unknown`` (for the dead letters)."""
    out = {k: events.filter(F.col(column) == k) for k in kinds}
    out["unknown"] = events.filter(F.col(column).isNull() | ~F.col(column).isin(*kinds))
    return out


def with_branch(events: DataFrame, kinds: Sequence[str], column: str = "event_type") -> DataFrame:
    """Add ``branch``: the type if it is known, else ``unknown``; one stream and one write partitioned by it serve all branches."""
    return events.withColumn("branch", F.when(F.col(column).isin(*kinds), F.col(column)).otherwise("unknown"))


def book_levels(deltas: DataFrame) -> DataFrame:
    """Current quantity per (symbol, side, price) from depth changes; a streaming aggregate.

    State is keyed by price level, so one busy symbol spreads over its prices.
    A quantity of 0 says the level is gone; its state stays, which bounds this to
    a known set of prices.  ``ordered.book_levels`` lets empty levels go.
    """
    return deltas.groupBy("symbol", "side", "price").agg(F.max_by("qty", "seq").alias("qty"), F.max("seq").alias("seq"))


class FunctionChain:
    """Named DataFrame -> DataFrame functions applied in order."""

    def __init__(self, functions: Mapping[str, Transform] | None = None) -> None:
        self._functions: dict[str, Transform] = dict(functions or {})

    def add(self, name: str, function: Transform) -> "FunctionChain":
        self._functions[name] = function
        return self

    def remove(self, name: str) -> "FunctionChain":
        self._functions.pop(name, None)
        return self

    def apply(self, events: DataFrame) -> DataFrame:
        for function in self._functions.values():
            events = events.transform(function)
        return events
