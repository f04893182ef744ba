"""Positions and profit: FIFO lots, cash, average cost, equity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import ratio
from tickloom.plans.merging import asof_join, overlap_points
from tickloom.plans.recurrence import recurrence
from tickloom.plans.series import placed, running, unplaced, windowed
from tickloom.session import stored


def is_buy(side: str = "side") -> Column:
    return F.col(side).isin("bid", "buy")


def is_sell(side: str = "side") -> Column:
    return F.col(side).isin("ask", "sell")


def signed_volume() -> Column:
    """Bought volume positive, sold negative; an unknown side or volume moves nothing."""
    moved = F.when(is_buy(), F.col("volume")).when(is_sell(), -F.col("volume"))
    return F.coalesce(moved, F.lit(0.0))


def unplaced_fills(df: DataFrame) -> DataFrame:
    """Executions that no position can take: side neither bought nor sold, or no volume or price."""
    return df.filter(~F.coalesce(is_buy() | is_sell(), F.lit(False)) | F.col("volume").isNull() | F.col("price").isNull())


def _fifo_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int | None) -> DataFrame:
    """Buys and matched sells with the end ``hi`` of their lot on the axis of bought volume.

    With S the running signed volume, sells matched so far are
    (all sells so far) + min(0, lowest S so far): whatever drove S below zero
    found no inventory and opens nothing.
    """
    how = {"keys": keys, "order": order, "rows_per_task": rows_per_task}
    df = df.filter((is_buy() | is_sell()) & F.col("volume").isNotNull())
    sums = running(
        placed(df, **how),
        {
            "_bought": ("sum", F.when(is_buy(), F.col("volume")).otherwise(F.lit(0.0))),
            "_sold": ("sum", F.when(is_buy(), F.lit(0.0)).otherwise(F.col("volume"))),
            "_pos": ("sum", signed_volume()),
        },
        **how,
    )
    low = running(sums, {"_low": ("min", F.col("_pos"))}, **how).withColumn(
        "_matched", F.col("_sold") + F.least(F.lit(0.0), F.col("_low"))
    )
    steps = windowed(low, lambda d, w: d.withColumn("_before", F.coalesce(F.lag("_matched").over(w), F.lit(0.0))), back=1, **how)
    lots = steps.filter(is_buy() | (F.col("_matched") > F.col("_before")))
    return unplaced(lots).select(*df.columns, F.when(is_buy(), F.col("_bought")).otherwise(F.col("_matched")).alias("hi"))


def fifo_lots(
    df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), rows_per_task: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Buys and matched sells as two sets of consecutive lots (column ``hi``), computed once for both."""
    lots = stored(_fifo_steps(df, keys, order, rows_per_task))
    return lots.filter(is_buy()), lots.filter(~is_buy())


def fifo_pnl(
    df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), rows_per_task: int | None = None
) -> DataFrame:
    """Realised profit per sell: every piece of it against the buy it meets first-in first-out."""
    lots = _fifo_steps(df, keys, order, rows_per_task)
    lot = F.struct(*[c for c in lots.columns if c not in keys])
    points = lots.select(
        *keys, (-F.col("hi")).alias("_neg"), is_buy().cast("int").alias("_side"),
        F.when(~is_buy(), lot).alias("_l"), F.when(is_buy(), F.struct("price")).alias("_r"),
    )
    met = overlap_points(points, keys=keys, rows_per_task=rows_per_task)
    gain = (F.col("left.price") - F.col("right.price")) * F.col("overlap")
    return met.groupBy(*keys, *[F.col(f"left.{c}").alias(c) for c in df.columns if c not in keys], F.col("left.hi").alias("hi")).agg(
        F.sum(gain).alias("pnl"), F.sum("overlap").alias("matched"), F.count("*").alias("lots")
    ).drop("hi")


def cash_and_position(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    # A fill without a price moves neither, so that position and cash stay in step.
    flow = F.when(F.col("price").isNotNull(), signed_volume()).otherwise(F.lit(0.0))
    return running(df, {"position": ("sum", flow), "cash": ("sum", F.coalesce(-flow * F.col("price"), F.lit(0.0)))}, keys=keys, order=order, **how)


def equity_curve(quotes: DataFrame, fills: DataFrame, start_cash: float = 0.0, **how) -> DataFrame:
    """Per quote: cash and position from the fills so far, value at mid, spread."""
    state = cash_and_position(fills, **how).select("symbol", "ts", "seq", "position", "cash")
    on = asof_join(quotes, state, **how)
    mid = (F.col("bid") + F.col("ask")) / 2
    pos, cash = F.coalesce("position", F.lit(0.0)), F.coalesce("cash", F.lit(0.0)) + F.lit(start_cash)
    return on.withColumns(
        {"position": pos, "cash": cash, "mid_price": mid, "spread": F.col("ask") - F.col("bid"), "value": cash + pos * mid}
    )


def average_cost(
    df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), rows_per_task: int | None = None
) -> DataFrame:
    """Average-cost book per key: position, average price and realised profit after every execution.

    Adding to a position averages the price in, reducing keeps it, crossing
    zero restarts at the trade price.  Given the positions before and after,
    which are a running sum, each case is a step cost = a * cost + b.  A row without
    price or volume, or of unknown side, leaves the book as it is.
    """
    how = {"keys": keys, "order": order, "rows_per_task": rows_per_task}
    pos = running(placed(df, **how).withColumn("_q", F.when(F.col("price").isNotNull(), signed_volume()).otherwise(F.lit(0.0))), {"position": ("sum", F.col("_q"))}, **how)
    before, after, q, p = F.col("position") - F.col("_q"), F.col("position"), F.col("_q"), F.coalesce("price", F.lit(0.0))
    tiny = 1e-9
    opens = F.abs(before) < tiny
    adds = before * q > 0
    flips = ~opens & ~adds & (F.abs(q) > F.abs(before) + tiny)
    still = q == 0
    a = F.when(still, F.lit(1.0)).when(opens | flips, F.lit(0.0)).when(adds, F.lit(1.0)).otherwise(F.coalesce(ratio(after, before), F.lit(0.0)))
    b = F.when(still, F.lit(0.0)).when(opens | adds, q * p).when(flips, after * p).otherwise(F.lit(0.0))
    stepped = pos.withColumns({"_a": a, "_b": b, "_before": before})
    cost = recurrence(stepped, "_a", "_b", "_cost", before="_cost_before", **how)
    avg_before = F.coalesce(ratio("_cost_before", "_before"), F.lit(0.0))
    closing = F.when((F.col("_before") * F.col("_q") < 0), F.least(F.abs("_before"), F.abs("_q"))).otherwise(F.lit(0.0))
    realised = closing * (F.col("price") - avg_before) * F.signum("_before")
    avg = F.when(F.abs("position") < tiny, F.lit(0.0)).otherwise(ratio("_cost", "position"))
    out = cost.withColumns({"realized": realised, "average_price": avg})
    total = running(out, {"realized_pnl": ("sum", F.col("realized"))}, **how)
    return unplaced(total).drop("_q", "_a", "_b", "_before", "_cost", "_cost_before")


def last_state(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), columns: Sequence[str] = ()) -> DataFrame:
    """Values of the last row per key, reduced in each task before the shuffle."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in columns])


def mark_to_market(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """Market value and unrealised profit per position (qty, avg_price) at the mark price."""
    on = positions.join(marks, "symbol", "left")
    price = F.coalesce("mark_price", "avg_price")
    return on.withColumns({"market_value": F.col("qty") * price, "unrealized_pnl": (price - F.col("avg_price")) * F.col("qty")})


def position_totals(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count_if(F.col("qty") != 0).alias("open_positions"), F.sum("market_value").alias("net_value"),
        F.sum(F.abs("market_value")).alias("gross_value"), F.sum("unrealized_pnl").alias("unrealized_pnl"),
        F.sum("realized_pnl").alias("realized_pnl"),
    )
