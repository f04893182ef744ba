"""Reference-data joins: marks, limits, scenarios, venues, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.merging import asof_join
from tickloom.plans.series import broadcast_if_small


def equi_join_on_time(df: DataFrame, a: str, b: str, value: str = "price", at: str = "bar", name: str = "symbol") -> DataFrame:
    """Two series side by side on their common times."""
    left = df.filter(F.col(name) == a).select(at, F.col(value).alias("value_a"))
    right = df.filter(F.col(name) == b).select(at, F.col(value).alias("value_b"))
    return left.join(right, at)


def latest_marks(prices: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Last price per symbol, reduced in each task before the shuffle."""
    return prices.groupBy("symbol").agg(F.max_by("price", F.struct(*order)).alias("mark_price"))


def mark_join(positions: DataFrame, marks: DataFrame) -> DataFrame:
    return positions.join(marks, "symbol", "left")


def scenario_join(positions: DataFrame, scenarios: DataFrame, on: str = "symbol") -> DataFrame:
    """Positions against the shocks of every scenario; assets without a shock add nothing."""
    return positions.join(broadcast_if_small(scenarios), on, "inner").withColumn(
        "pnl", F.col("market_value") * F.col("shock")
    )


def limit_join(rows: DataFrame, limits: DataFrame, limit_type: str) -> DataFrame:
    """The symbol's own limit of this type, else the global one (symbol null)."""
    mine = limits.filter(F.col("limit_type") == limit_type)
    own = mine.filter(F.col("symbol").isNotNull()).select("symbol", F.col("limit_value").alias("_own"))
    # One row at most: the global limit of one type.
    everyone = mine.filter(F.col("symbol").isNull()).agg(F.max("limit_value").alias("_global"))
    return (
        rows.join(broadcast_if_small(own), "symbol", "left").crossJoin(F.broadcast(everyone))
        .withColumn("limit_value", F.coalesce("_own", "_global")).withColumn("has_own_limit", F.col("_own").isNotNull())
        .drop("_own", "_global")
    )


def venue_join(prices: DataFrame, primary: str, venue: str = "venue", **series) -> DataFrame:
    """Each venue price with the primary venue's latest price at that time."""
    main = prices.filter(F.col(venue) == primary).select("symbol", "ts", "seq", F.col("price").alias("primary_price"))
    return asof_join(prices.filter(F.col(venue) != primary), main, **series)


def routing_join(orders: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    return orders.join(broadcast_if_small(routes.select("symbol", "broker")), "symbol", "left").withColumn(
        "broker", F.coalesce("broker", F.lit(default))
    )


def own_trades(
    trades: DataFrame, own_orders: DataFrame, buy_id: str = "buy_order_id", sell_id: str = "sell_order_id", mark: str | None = None,
    rows_per_task: int = 1_000_000,
) -> tuple[DataFrame, DataFrame] | DataFrame:
    """Trades with a buy or sell order of ours, and the rest; or, with ``mark``, one frame with that boolean column.

    An OR over two ids would force a nested-loop join, so each id is tested by
    its own hash join.  Trades lie by sell order in parts of ``rows_per_task``
    rows, which a sum by both orders takes up as they are.
    """
    ids = own_orders.select("order_id").distinct()
    buys, sells = ids.select(F.col("order_id").alias("_own_buy")), ids.select(F.col("order_id").alias("_own_sell"))
    parts = max(1, -(-trades.count() // rows_per_task))
    tested = trades.join(buys, F.col(buy_id) == F.col("_own_buy"), "left").repartition(parts, sell_id).join(sells, F.col(sell_id) == F.col("_own_sell"), "left")
    name = mark or "_mine"
    marked = tested.withColumn(name, F.col("_own_buy").isNotNull() | F.col("_own_sell").isNotNull()).drop("_own_buy", "_own_sell")
    return marked if mark else (marked.filter(name).drop(name), marked.filter(~F.col(name)).drop(name))
