"""Named queries with their comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Whole-number columns that SQL would give as INTEGER or DOUBLE; Spark gives bigint.
WHOLE = {
    "best_quote_ffill": ("line_no",), "routing_join": ("l_linenumber",), "fifo_pnl": ("line_no",), "cash_and_position": ("line_no",),
    "avg_cost_position": ("line_no",), "limit_checks": ("line_no", "violations"), "trade_direction": ("trade_direction",),
    "order_flow": ("direction_sum_10",), "jump": ("jump_indicator",), "forward_label": ("direction",), "time_series_split": ("fold",),
    "dq_book_structure": ("has_bids", "has_asks"), "time_parts": ("is_market_open", "is_market_close", "is_lunch_time"),
    "session_flags": ("is_open", "is_lunch"),
}

TICKS = """ticks AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, ts, event_id AS seq, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_type,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'bid'
              WHEN event_type IN ('view', 'signup') THEN 'ask' END AS side,
         value - (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) / 1000 AS bid,
         value + (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) / 1000 AS ask,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS bid_volume,
         100 - CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ask_volume
  FROM events)"""

TRADES = """trades AS (
  SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_shipdate AS ts, l_orderkey AS order_id,
         l_linenumber AS line_no, l_extendedprice / l_quantity AS price, l_quantity AS volume,
         CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side, l_discount AS discount,
         l_tax AS tax, l_returnflag AS flag, l_suppkey AS supplier
  FROM lineitem)"""

TRADE_SORT = "ts, order_id, line_no, volume, price, discount, tax, flag, supplier"
W = "PARTITION BY symbol ORDER BY ts, seq"


def nudge(digits: int) -> float:
    """Added before rounding on both sides, so that exact halves fall the same way."""
    return 3.1 * 10.0 ** -(digits + 4)


def nudged(sql: str) -> str:
    """Put ``nudge`` into every round(x, n) of a comparison query."""
    out, i = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.end() <= i:
            continue
        depth, j, comma = 1, m.end(), None
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        inner = nudged(sql[m.end():comma])
        n = int(sql[comma + 1:j - 1])
        out += sql[i:m.end()] + f"CAST({inner} AS DOUBLE) + {nudge(n)!r}, {n})"
        i = j
    return out + sql[i:]


def rounded(plain: str, doubles: str, source: str, digits: int = 6) -> str:
    """SELECT of ``plain`` columns as they are and ``doubles`` rounded."""
    cols = plain.split() + [
        f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in doubles.split()
    ]
    return f"SELECT {', '.join(cols)} FROM {source}"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and drop the time zone, as ``rounded`` does on the SQL side."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL twin if there is one."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql:
            whole = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in WHOLE.get(name, ()))
            SQL[name] = f"SELECT * REPLACE ({whole}) FROM ({nudged(sql)})" if whole else nudged(sql)
        return fn

    return keep


BOOK_LEVELS = """lv AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('month', l_shipdate) AS ts,
         CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side,
         floor(l_extendedprice / l_quantity) + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1000 END AS price,
         l_quantity AS volume, l_orderkey AS order_id, l_linenumber AS line_no, l_discount AS discount,
         l_tax AS tax, l_returnflag AS flag, l_partkey AS part
  FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END,
         order_id, line_no, volume, discount, tax, flag, part) AS level FROM lv)"""
