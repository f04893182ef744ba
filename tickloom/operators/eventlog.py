"""Event log: selection, appending, read models of orders and positions, consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.series import numbered, placed, running, unplaced, windowed

CREATED, FILLED, CANCELLED = "order_created", "order_filled", "order_cancelled"


def by_aggregate(log: DataFrame, aggregate_id: str, first: int | None = None, last: int | None = None) -> DataFrame:
    out = log.filter(F.col("aggregate_id") == aggregate_id)
    if first is not None:
        out = out.filter(F.col("version") >= first)
    if last is not None:
        out = out.filter(F.col("version") <= last)
    return out.orderBy("version")


def by_type_time(log: DataFrame, event_type: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Events of a type in an inclusive time range, in time order; both predicates reach the scan."""
    out = log.filter(F.col("event_type") == event_type)
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    if end is not None:
        out = out.filter(F.col("ts") <= end)
    return out.orderBy("ts")


def versioned(events: DataFrame, order: Sequence[str] = ("ts", "seq"), after: DataFrame | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Number the events of each aggregate, continuing from the versions of an existing log."""
    out = numbered(events, "version", keys=("aggregate_id",), order=order, rows_per_task=rows_per_task)
    if after is None:
        return out
    top = after.groupBy("aggregate_id").agg(F.max("version").alias("_top"))
    return out.join(top, "aggregate_id", "left").withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top")


def append(events: DataFrame, path: str, span: str = "day") -> None:
    """Append to a Parquet log laid out by type and first date of the ``span``; a busy type and span is split over tasks."""
    dated = events.withColumn("date", F.to_date(F.date_trunc(span, "ts")))
    dated.repartitionByRange("event_type", "date", "ts").write.mode("append").partitionBy("event_type", "date").parquet(path)


def order_state(log: DataFrame) -> DataFrame:
    """One row per order from its events (columns order_id, event_type, version, quantity, symbol, side).

    The fold over events is a set of aggregates, combined before the shuffle.
    """
    kind = F.col("event_type")
    made = F.when(kind == CREATED, F.struct("symbol", "side", "quantity", "ts"))
    states = log.groupBy("order_id").agg(
        F.max(made).alias("_made"),
        F.sum(F.when(kind == FILLED, F.col("quantity")).otherwise(F.lit(0.0))).alias("filled"),
        F.count_if(kind == CANCELLED).alias("_cancels"), F.max("version").alias("version"),
    )
    quantity = F.col("_made.quantity")
    status = (
        F.when(F.col("_cancels") > 0, "cancelled").when(F.col("filled") >= quantity, "filled")
        .when(F.col("filled") > 0, "partial").otherwise("new")
    )
    return states.select(
        "order_id", F.col("_made.symbol").alias("symbol"), F.col("_made.side").alias("side"), quantity.alias("quantity"), "filled",
        F.greatest(quantity - F.col("filled"), F.lit(0.0)).alias("remaining"), status.alias("status"), "version",
    )


def orders_by_symbol(states: DataFrame, symbol: str, status: str | None = None) -> DataFrame:
    out = states.filter(F.col("symbol") == symbol)
    return out.filter(F.col("status") == status) if status else out


def position_state(requested: DataFrame, marked: DataFrame) -> DataFrame:
    """The position of each requested symbol; zeros where there is none."""
    cols = [c for c in marked.columns if c != "symbol"]
    joined = requested.select("symbol").distinct().join(marked, "symbol", "left")
    return joined.select("symbol", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


def portfolio_pnl(positions: DataFrame, by: str = "strategy") -> DataFrame:
    return positions.groupBy(by).agg(
        F.count_if(F.col("qty") != 0).alias("open_positions"), F.sum("market_value").alias("market_value"),
        F.sum("unrealized_pnl").alias("unrealized_pnl"), F.sum("realized_pnl").alias("realized_pnl"),
        F.sum(F.col("unrealized_pnl") + F.col("realized_pnl")).alias("total_pnl"),
    )


def illegal_transitions(log: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Events that fill more than is left, or touch an order already filled or cancelled."""
    how = {"keys": ("order_id",), "order": ("version",), "rows_per_task": rows_per_task}
    kind = F.col("event_type")
    state = running(
        placed(log, **how),
        {
            "_ordered": ("max", F.when(kind == CREATED, F.col("quantity"))),
            "_filled": ("sum", F.when(kind == FILLED, F.col("quantity")).otherwise(F.lit(0.0))),
            "_cancels": ("count", F.when(kind == CANCELLED, F.lit(1))),
        },
        **how,
    )

    def before(d, w):
        done = (F.col("_filled") >= F.col("_ordered")) | (F.col("_cancels") > 0)
        return d.withColumn("_done", F.coalesce(F.lag(done).over(w), F.lit(False)))

    over = (kind == FILLED) & (F.col("_filled") > F.col("_ordered"))
    late = F.col("_done") & kind.isin(FILLED, CANCELLED)
    fault = F.when(late, "after_terminal").when(over, "overfill")
    out = windowed(state, before, back=1, **how).withColumn("fault", fault).filter(F.col("fault").isNotNull())
    return unplaced(out).drop("_ordered", "_filled", "_cancels", "_done")


def execution_summary(orders: DataFrame, executions: DataFrame) -> DataFrame:
    """Per order: filled and remaining quantity, completion, average price, commission and fees."""
    done = executions.groupBy("order_id").agg(
        F.sum("qty").alias("filled"), F.sum(F.col("qty") * F.col("price")).alias("_value"), F.count("*").alias("executions"),
        F.sum("commission").alias("commission"), F.sum("fees").alias("fees"),
    )
    out = orders.join(done, "order_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("filled", "_value", "commission", "fees")})
    return out.select(
        *orders.columns, "filled", F.coalesce("executions", F.lit(0)).alias("executions"),
        F.greatest(F.col("quantity") - F.col("filled"), F.lit(0.0)).alias("remaining"), (F.col("filled") >= F.col("quantity")).alias("complete"),
        (F.try_divide("filled", "quantity") * 100).alias("fill_pct"), F.try_divide("_value", "filled").alias("avg_fill_price"), "commission", "fees",
    )
