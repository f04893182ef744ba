"""Row predicates and message encodings as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import ColumnLike, as_col

# Bounds of a plausible price, volume and message age.
PRICE_BOUNDS = (1e-4, 1e6)
VOLUME_BOUNDS = (1.0, 1e6)
MESSAGE_PRICE_MAX = 1_000_000.0
MESSAGE_AGE_SECONDS = 300
QUALITY_AGE_MS = 5000
SIDES = ("bid", "ask", "buy", "sell")
ORDER_TYPES = ("market", "limit", "cancel", "modify")

# Fields each message type must carry.
REQUIRED_FIELDS = {
    "market_data": ("symbol", "bid", "ask", "timestamp"),
    "order_event": ("order_id", "symbol", "side", "quantity", "timestamp"),
    "execution": ("execution_id", "order_id", "symbol", "side", "quantity", "price", "timestamp"),
    "position_update": ("symbol", "position", "average_price", "timestamp"),
}


def all_of(*tests: Column) -> Column:
    """Conjunction in which null counts as false."""
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests])


def clean_row(
    price: ColumnLike = "price", volume: ColumnLike = "volume", ts: ColumnLike = "ts",
    price_bounds: tuple[float, float] = PRICE_BOUNDS, volume_bounds: tuple[float, float] = VOLUME_BOUNDS,
) -> Column:
    return all_of(
        as_col(ts).isNotNull(), as_col(price).between(*price_bounds), as_col(volume).between(*volume_bounds)
    )


def clean_row_fast(price: ColumnLike = "price", volume: ColumnLike = "volume") -> Column:
    p, v = as_col(price), as_col(volume)
    return all_of(p > 0, p < 1e6, v > 0, v < 1e9)


def filter_spec(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Filter by column -> (low, high) | list or set | callable on Column | value."""
    for name, rule in spec.items():
        if name not in df.columns:
            continue
        c = F.col(name)
        if isinstance(rule, tuple) and len(rule) == 2:
            df = df.filter(c.between(*rule))
        elif isinstance(rule, (list, set, frozenset)):
            df = df.filter(c.isin(*rule))
        elif isinstance(rule, Callable):
            df = df.filter(rule(c))
        else:
            df = df.filter(c == rule)
    return df


def query_rows(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.expr(text))


def plausible_message(
    symbol: str = "symbol", ts: str = "ts", price: str = "price", quantity: str = "quantity",
    bid: str = "bid", ask: str = "ask", now: Column | None = None,
) -> Column:
    """Symbol and time set, price and size in range, bid below ask, within five minutes of ``now``."""
    p, q, b, a = F.col(price), F.col(quantity), F.col(bid), F.col(ask)
    now = F.current_timestamp() if now is None else now
    age = F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))
    return all_of(
        F.length(symbol) > 0,
        F.col(ts).isNotNull(),
        p.isNull() | ((p > 0) & (p <= MESSAGE_PRICE_MAX)),
        q.isNull() | (q >= 0),
        b.isNull() | a.isNull() | (b == 0) | (a == 0) | (b < a),
        age <= MESSAGE_AGE_SECONDS * 1_000_000,
    )


def message_faults(
    price: str = "price", volume: str = "volume", age_ms: Column | None = None, outlier: Column | None = None
) -> dict[str, Column]:
    """One flag per quality rule of a feed message."""
    p, v = F.col(price), F.col(volume)
    out = {
        "bad_price": F.coalesce(F.isnan(p) | (p <= 0) | (F.abs(p) == F.lit(float("inf"))), F.lit(False)),
        "bad_volume": F.coalesce(v < 0, F.lit(False)),
    }
    if age_ms is not None:
        out["too_old"] = F.coalesce(age_ms > QUALITY_AGE_MS, F.lit(False))
    if outlier is not None:
        out["outlier"] = F.coalesce(outlier, F.lit(False))
    return out


def quote_valid(bid: str = "bid", ask: str = "ask") -> Column:
    return all_of(F.col(bid) > 0, F.col(ask) > 0, F.col(bid) < F.col(ask))


def order_faults(price: str = "price", volume: str = "volume", side: str = "side") -> Column:
    """Messages about an order record; an empty array means it is valid."""
    p, v, s = F.col(price), F.col(volume), F.col(side)
    lo, hi = PRICE_BOUNDS
    vlo, vhi = VOLUME_BOUNDS
    return F.array_compact(
        F.array(
            F.when(p.isNull(), F.lit("Missing required field: price")),
            F.when(v.isNull(), F.lit("Missing required field: volume")),
            F.when(s.isNull(), F.lit("Missing required field: side")),
            F.when(~p.between(lo, hi), F.lit("Price out of valid range")),
            F.when(~F.floor(v).between(vlo, vhi), F.lit("Volume out of valid range")).when(
                v <= 0, F.lit("Volume must be positive")
            ),
            F.when(~F.lower(s).isin(*SIDES), F.concat(F.lit("Invalid side: "), s)),
        )
    )


def encode_market_data(symbol="symbol", bid="bid", ask="ask", bid_size="bid_volume", ask_size="ask_volume", ts="ts") -> Column:
    b, a = F.col(bid), F.col(ask)
    return F.to_json(
        F.struct(
            F.lit("market_data").alias("type"), F.col(symbol).alias("symbol"), b.alias("bid"), a.alias("ask"),
            F.col(bid_size).alias("bid_size"), F.col(ask_size).alias("ask_size"),
            (a - b).alias("spread"), ((a + b) / 2).alias("mid_price"), _iso(ts).alias("timestamp"),
        )
    )


def encode_order_event(order_id="order_id", symbol="symbol", side="side", quantity="quantity", price="price",
                       order_type="order_type", status="status", ts="ts") -> Column:
    return F.to_json(
        F.struct(
            F.lit("order_event").alias("type"), F.col(order_id).alias("order_id"), F.col(symbol).alias("symbol"),
            F.upper(side).alias("side"), F.col(quantity).alias("quantity"), F.col(price).alias("price"),
            F.upper(order_type).alias("order_type"), F.upper(status).alias("status"), _iso(ts).alias("timestamp"),
        )
    )


def encode_execution(execution_id="execution_id", order_id="order_id", symbol="symbol", side="side",
                     quantity="quantity", price="price", commission="commission", ts="ts") -> Column:
    return F.to_json(
        F.struct(
            F.lit("execution").alias("type"), F.col(execution_id).alias("execution_id"),
            F.col(order_id).alias("order_id"), F.col(symbol).alias("symbol"), F.upper(side).alias("side"),
            F.col(quantity).alias("quantity"), F.col(price).alias("price"),
            (F.col(quantity) * F.col(price)).alias("notional"), F.col(commission).alias("commission"),
            _iso(ts).alias("timestamp"),
        )
    )


def encode_position(symbol="symbol", position="position", average_price="average_price",
                    unrealized="unrealized_pnl", realized="realized_pnl", ts="ts") -> Column:
    q, a, u, r = F.col(position), F.col(average_price), F.col(unrealized), F.col(realized)
    return F.to_json(
        F.struct(
            F.lit("position_update").alias("type"), F.col(symbol).alias("symbol"), q.alias("position"),
            a.alias("average_price"), (q * a).alias("market_value"), u.alias("unrealized_pnl"),
            r.alias("realized_pnl"), (u + r).alias("total_pnl"), _iso(ts).alias("timestamp"),
        )
    )


def _iso(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def valid_message(payload: ColumnLike) -> Column:
    """Whether a JSON message of a known type carries its fields in range; unknown types pass."""
    text = as_col(payload)

    def field(name: str) -> Column:
        return F.get_json_object(text, f"$.{name}")

    def number(name: str) -> Column:
        return field(name).try_cast("double")

    kind = field("type")
    timed = field("timestamp").try_cast("timestamp").isNotNull()
    sided = F.upper(field("side")).isin("BUY", "SELL")
    price_ok = field("price").isNull() | (number("price") > 0)
    rules = {
        "market_data": all_of(number("bid") > 0, number("ask") > 0, number("bid") < number("ask")),
        "order_event": all_of(sided, number("quantity") > 0, price_ok),
        "execution": all_of(sided, number("quantity") > 0, number("price") > 0),
        "position_update": all_of(
            number("position").isNotNull(), number("average_price").isNotNull(),
            (number("position") == 0) | (number("average_price") > 0),
        ),
    }
    out = F.when(kind.isNull(), F.lit(False))
    for name, rule in rules.items():
        present = [field(f).isNotNull() for f in REQUIRED_FIELDS[name]]
        out = out.when(kind == name, all_of(*present, timed, rule))
    return out.otherwise(F.lit(True))
