"""Compare a registered query with its DuckDB twin, value by value."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r))
    return [columns[i] for i in order], out


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cur = con.execute(sql)
    want_cols, want = _table([c[0] for c in cur.description], cur.fetchall())
    got_cols, got = _table(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cols = [c for c, x, y in zip(got_cols, g, w) if x != y]
        return f"{len(bad)} rows differ in {cols}: {[x for x, y in zip(g, w) if x != y]} != {[y for x, y in zip(g, w) if x != y]}; row {g}"
    return None
