"""Column expressions: coercion, naming, rounding, formatting, session flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Null tokens, code names and time formats accepted in tick files.
NULL_TOKENS = ("", "NULL", "null", "NaN", "nan")
SIDE_CODES = {"b": "bid", "bid": "bid", "buy": "bid", "1": "bid", "s": "ask", "ask": "ask", "sell": "ask", "2": "ask"}
ORDER_TYPE_CODES = {
    "m": "market", "mkt": "market", "market": "market",
    "l": "limit", "lmt": "limit", "limit": "limit",
    "c": "cancel", "cnl": "cancel", "cancel": "cancel",
}
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "yyyyMMdd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
)
SYMBOL_PATTERN = "^[A-Z][A-Z0-9]{0,12}$"

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c: ColumnLike) -> Column:
    """Text with the null tokens turned into null."""
    c = as_col(c)
    return F.when(~c.isin(*NULL_TOKENS), c)


def to_number(c: ColumnLike, kind: str = "double") -> Column:
    """Numeric value, null where it does not parse or is NaN."""
    v = as_col(c).try_cast(kind)
    return F.when(~F.isnan(v.cast("double")), v)


def parse_time(c: ColumnLike, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """First format that fits, row by row."""
    c = as_col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], c.try_cast("timestamp"))


def epoch_time(c: ColumnLike) -> Column:
    """Epoch number in s, ms, us or ns to timestamp; the unit follows from the magnitude."""
    v = as_col(c).cast("long")
    size = F.abs(v)
    return (
        F.when(size >= 10**17, F.timestamp_micros(F.call_function("div", v, F.lit(1000))))
        .when(size >= 10**14, F.timestamp_micros(v))
        .when(size >= 10**11, F.timestamp_millis(v))
        .otherwise(F.timestamp_seconds(v))
    )


def _coded(c: ColumnLike, codes: Mapping[str, str]) -> Column:
    low = F.lower(as_col(c).cast("string"))
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, low), low)


def side_code(c: ColumnLike) -> Column:
    return _coded(c, SIDE_CODES)


def order_type_code(c: ColumnLike) -> Column:
    return _coded(c, ORDER_TYPE_CODES)


def symbol_code(c: ColumnLike) -> Column:
    return F.upper(F.replace(as_col(c), F.lit("/"), F.lit("")))


def round_to_tick(price: ColumnLike, tick: float) -> Column:
    """Nearest multiple of ``tick``, halves to even."""
    return F.bround(as_col(price) / F.lit(tick)) * F.lit(tick)


def safe_divide(a: ColumnLike, b: ColumnLike, default: float = 0.0) -> Column:
    """a / b; ``default`` where b is within 1e-10 of zero; null stays null."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.when(F.abs(b) < 1e-10, F.when(a.isNotNull(), F.lit(default))).otherwise(a / b)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def quotient(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as floating point has it: infinite, or NaN for 0 / 0, where b is zero; null stays null."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(at_zero)).otherwise(a / b)


def log_quotient(a: ColumnLike, b: ColumnLike) -> Column:
    """Logarithm of ``quotient``, minus infinity where that is zero."""
    q = quotient(a, b)
    return F.when(q == 0, F.lit(float("-inf"))).otherwise(F.log(q))


def format_price(c: ColumnLike, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", as_col(c))


def format_volume(c: ColumnLike) -> Column:
    return F.format_number(as_col(c).cast("long"), 0)


def format_pnl(c: ColumnLike, digits: int = 2) -> Column:
    c = as_col(c)
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string(f"%.{digits}f", c))


def format_percent(c: ColumnLike, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", as_col(c) * 100)


def format_large(c: ColumnLike, digits: int = 1) -> Column:
    """1234 -> 1.2K, with M and B beyond."""
    c = as_col(c)
    size = F.abs(c)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))

    def text(scale: float, suffix: str) -> Column:
        return F.concat(sign, F.format_string(f"%.{digits}f", size / F.lit(scale)), F.lit(suffix))

    return F.when(size >= 1e9, text(1e9, "B")).when(size >= 1e6, text(1e6, "M")).when(size >= 1e3, text(1e3, "K")).otherwise(text(1.0, ""))


def format_duration(seconds: ColumnLike) -> Column:
    """Span of time with a unit fitting its size."""
    s = as_col(seconds)
    return (
        F.when(s < 1e-3, F.concat(F.format_string("%.1f", s * 1e6), F.lit("us")))
        .when(s < 1, F.concat(F.format_string("%.1f", s * 1e3), F.lit("ms")))
        .when(s < 60, F.concat(F.format_string("%.1f", s), F.lit("s")))
        .when(s < 3600, F.concat(F.format_string("%.1f", s / 60), F.lit("m")))
        .otherwise(F.concat(F.format_string("%.1f", s / 3600), F.lit("h")))
    )


def valid_symbol(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c).rlike(SYMBOL_PATTERN), F.lit(False))


def valid_price(c: ColumnLike) -> Column:
    c = as_col(c)
    return c.isNull() | (c > 0)


def valid_quantity(c: ColumnLike) -> Column:
    """Positive whole number."""
    c = as_col(c)
    return F.coalesce((c > 0) & (c == F.floor(c)), F.lit(False))


def clean_cell(c: ColumnLike) -> Column:
    return F.trim(F.replace(as_col(c), F.lit(","), F.lit("")))


def trim_map(c: ColumnLike) -> Column:
    return F.transform_values(as_col(c), lambda _, v: F.trim(v))


def trim_array(c: ColumnLike) -> Column:
    return F.transform(as_col(c), lambda v: F.trim(v))


def squash(c: ColumnLike, method: str = "tanh") -> Column:
    """Map a signal into [-1, 1] by tanh, clip or sigmoid."""
    c = as_col(c)
    if method == "tanh":
        return F.tanh(c)
    if method == "clip":
        return clip(c, -1.0, 1.0)
    if method == "sigmoid":
        return F.lit(2.0) / (F.lit(1.0) + F.exp(-c)) - F.lit(1.0)
    raise ValueError(f"unknown method {method}")


def clip(c: ColumnLike, low: float, high: float) -> Column:
    """Bound a value; null stays null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def time_parts(ts: ColumnLike) -> dict[str, Column]:
    """Clock fields and the flags of the opening half hour, the close and lunch."""
    ts = as_col(ts)
    h, m = F.hour(ts), F.minute(ts)
    day_us = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.date_trunc("day", ts).cast("timestamp"))
    return {
        "hour": h,
        "minute": m,
        "second": F.second(ts),
        "microsecond": F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)),
        "day_of_week": F.weekday(ts),
        "is_market_open": ((h == 9) & (m >= 30)).cast("int"),
        "is_market_close": ((h == 16) & (m == 0)).cast("int"),
        "is_lunch_time": (h == 12).cast("int"),
        "minutes_since_open": (day_us - F.lit(34_200_000_000)) / F.lit(60_000_000.0),
    }


def session_flags(ts: ColumnLike) -> dict[str, Column]:
    h = F.hour(as_col(ts))
    return {
        "is_open": ((h >= 9) & (h < 16)).cast("int"),
        "is_lunch": ((h >= 12) & (h < 13)).cast("int"),
    }
