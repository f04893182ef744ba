"""Stateful operators that see the rows of a key in event-time order, whatever batches they come in.

A row is held in the state until the watermark has passed its time; a timer then
releases the rows that are due, by key, sorted by time and tie columns.  No row
can come before a released one any more: the engine drops later ones and counts
them.  So the output depends on the rows and the lateness alone, not on how files
fall into batches.

Rows and timers are kept by hashed bucket of keys, what is known of a key by key:
a stream may have a key a row, and each state call is a message to the JVM.  A
bucket without due rows is not touched.

A stream's watermark begins at 1970, so rows up to then are late.  The state lies
in RocksDB.  A bucket is one task's work; what is held of it is its rows inside
the lateness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"
BUCKETS = 4096
ENRICHED = "symbol string, ts timestamp, seq long, kind string, price double, price_change double, price_change_pct double, side string"
LEVEL = "symbol string, side string, price double, qty double, ts timestamp, seq long"
_ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def interval_micros(text: str) -> int:
    """Microseconds of a fixed interval such as ``10 minutes`` or ``1 day 2 hours``."""
    units = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
    words = text.lower().removeprefix("interval ").split()
    total, scaled = 0, len(words) > 0 and len(words) % 2 == 0
    for number, unit in zip(words[::2], words[1::2]):
        scale = units.get(unit.rstrip("s"))
        if scale is None:
            scaled = False
            break
        total += round(float(number) * scale)
    if not scaled:
        raise ValueError(f"no fixed interval: {text!r}")
    return total


def _tie(values: Sequence) -> tuple:
    """A sort key in which null comes first, as in Spark's own order."""
    return tuple((v is not None, v) for v in values)


_NAN = float("nan")


def _one_value(v):
    """A key value that equals itself: one NaN, and tuples for lists."""
    if isinstance(v, (list, tuple)):
        return tuple(_one_value(x) for x in v)
    return _NAN if v != v else v


class InOrder(StatefulProcessor):
    """Holds rows (``us``, then the tie columns, then the rest) of a bucket of keys and hands those that are due to ``release``, by key and in order."""

    def __init__(self, columns: Sequence[str], schema: T.StructType, ties: int, keys: Sequence[str]) -> None:
        self.columns, self.schema, self.ties = list(columns), schema, ties
        self.places = [self.columns.index(k) for k in keys]
        self.key_schema = T.StructType([T.StructField(f"k{i}", schema[p].dataType) for i, p in enumerate(self.places)])

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def release(self, due: dict[tuple, list[tuple]], watermark: int) -> Iterator[Row]:
        raise NotImplementedError

    def wake(self, us: int, watermark: int) -> None:
        """A timer at the first millisecond that is not before ``us``, unless one comes earlier.

        Timers up to the watermark (in microseconds) do not count: the one that
        is being handled is still listed.
        """
        at = -(-us // 1000)
        if not any(watermark < t * 1000 <= at * 1000 for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.held.appendList(new)
            self.wake(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.held.get()]
        due = sorted((r for r in held if r[0] <= watermark), key=lambda r: (r[0], _tie(r[1 : 1 + self.ties])))
        later = [r for r in held if r[0] > watermark]
        if due:
            self.held.put(later) if later else self.held.clear()
        if later:
            self.wake(min(r[0] for r in later), watermark)
        by: dict[tuple, list[tuple]] = {}
        for r in due:
            by.setdefault(tuple(_one_value(r[p]) for p in self.places), []).append(r)
        return self.release(by, watermark)

    def close(self) -> None:
        pass


class Enrich(InOrder):
    """Price change of a tick against the symbol's tick before, side of a trade against the last tick."""

    def __init__(self) -> None:
        held = T.StructType.fromDDL("us long, seq long, symbol string, kind string, price double")
        super().__init__(held.names, held, 1, ["symbol"])

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", self.key_schema, "price double")

    def release(self, due, watermark) -> Iterator[Row]:
        for key, rows in due.items():
            before = self.last.getValue(key)
            last = before[0] if before is not None else None
            for us, seq, symbol, kind, price in rows:
                change = pct = side = None
                if kind == "tick":
                    if last is not None and price is not None:
                        change = price - last
                        pct = change / last * 100 if last else None
                    last = price if price is not None else last
                elif kind is not None and last is not None and price is not None:
                    side = "buy" if price >= last else "sell"
                elif kind is not None and last is not None:
                    side = "sell"
                yield Row(
                    symbol=symbol, ts=_ZERO + timedelta(microseconds=us), seq=seq, kind=kind, price=price, price_change=change, price_change_pct=pct, side=side
                )
            if last is not None and (before is None or last != before[0]):
                self.last.updateValue(key, (last,))


class Levels(InOrder):
    """Quantities of the price levels of the sides of books, of which only levels with a quantity are kept."""

    def __init__(self, ttl: int | None) -> None:
        held = T.StructType.fromDDL("us long, seq long, symbol string, side string, price double, qty double")
        super().__init__(held.names, held, 1, ["symbol", "side", "price"])
        self.ttl = ttl

    def init(self, handle) -> None:
        super().init(handle)
        self.levels = handle.getMapState("levels", self.key_schema, "qty double, us long")

    def release(self, due, watermark) -> Iterator[Row]:
        for key, rows in due.items():
            us, seq, symbol, side, price, qty = rows[-1]
            if qty is None or qty == 0:
                self.levels.removeKey(key)
            else:
                self.levels.updateValue(key, (qty, us))
            yield Row(symbol=symbol, side=side, price=price, qty=qty or 0.0, ts=_ZERO + timedelta(microseconds=us), seq=seq)
        if self.ttl is not None:
            kept = []
            for key, (_, us) in list(self.levels.iterator()):
                if us + self.ttl <= watermark:
                    self.levels.removeKey(key)
                    symbol, side, price = key
                    yield Row(symbol=symbol, side=side, price=price, qty=0.0, ts=_ZERO + timedelta(microseconds=us + self.ttl), seq=None)
                else:
                    kept.append(us)
            if kept:
                self.wake(min(kept) + self.ttl, watermark)


class Thin(InOrder):
    """The first row of a signature, then the first one beyond the horizon of the last row kept.

    ``oldest`` is a time no later than any in ``last``: signatures out of the
    horizon are looked for when it is, at most eight times a horizon.
    """

    def __init__(self, columns: Sequence[str], schema: T.StructType, ties: int, horizon: int, out: Sequence[str], keys: Sequence[str]) -> None:
        super().__init__(columns, schema, ties, keys)
        self.horizon, self.out, self.step = horizon, list(out), max(horizon // 8, 1000)
        self.taken = [self.columns.index(c) for c in out]

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", self.key_schema, "us long")
        self.oldest = handle.getValueState("oldest", "us long")

    def release(self, due, watermark) -> Iterator[Row]:
        first = self.oldest.get()
        oldest = first[0] if first is not None else None
        make = Row(*self.out)
        for key, rows in due.items():
            # Without ``oldest`` no signature of the bucket is known.
            before = self.last.getValue(key) if first is not None else None
            last = before[0] if before is not None else None
            for row in rows:
                if last is None or row[0] > last + self.horizon:
                    last = row[0]
                    yield make(*[row[i] for i in self.taken])
            if last + self.horizon < watermark:
                # Nothing that may still come is inside the horizon: an idle signature leaves no state.
                if before is not None:
                    self.last.removeKey(key)
            elif before is None or last != before[0]:
                self.last.updateValue(key, (last,))
                oldest = last if oldest is None else min(oldest, last)
        if oldest is not None and oldest + self.horizon < watermark:
            left = []
            for key, (us,) in list(self.last.iterator()):
                if us + self.horizon < watermark:
                    self.last.removeKey(key)
                else:
                    left.append(us)
            oldest = min(left, default=None)
        if oldest is not None:
            if first is None or oldest != first[0]:
                self.oldest.update((oldest,))
            self.wake(((oldest + self.horizon) // self.step + 1) * self.step, watermark)
        elif first is not None:
            self.oldest.clear()


def _grouped(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str, processor: InOrder, schema) -> DataFrame:
    timed = stream.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).withColumn("us", F.unix_micros(ts))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    return timed.withColumn("__bucket", bucket).groupBy("__bucket").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def enriched(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Price change of ticks and side of trades of a stream (symbol, ts, seq, kind, price), as ``enrich.enrich_batch`` gives them for all rows.

    Rows without a time are left out; a row later than ``lateness`` is dropped
    and counted.  A row comes out once the watermark has passed it.
    """
    rows = stream.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "kind", F.col("price").cast("double").alias("price"))
    return _grouped(rows, ["symbol"], "ts", lateness, Enrich(), T.StructType.fromDDL(ENRICHED))


def book_levels(deltas: DataFrame, lateness: str = LATENESS, ttl: str | None = None) -> DataFrame:
    """Changed levels of a stream of depth changes (symbol, side, price, qty, ts, seq), in update form: symbol, side, price, qty, ts, seq.

    A level at quantity 0 leaves the state, and so does one that was not changed
    for ``ttl`` of event time; it comes out with quantity 0 (then without seq).
    Levels need a price.
    """
    rows = deltas.where("price IS NOT NULL").select(
        "symbol", "side", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"),
        F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"),
    )
    return _grouped(rows, ["symbol", "side"], "ts", lateness, Levels(interval_micros(ttl) if ttl else None), T.StructType.fromDDL(LEVEL))


def thinned(stream: DataFrame, signature: Sequence[str], horizon: str, order: Sequence[str], ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Rows of a stream that are the first of their signature, or more than ``horizon`` after the last one kept.

    ``order`` are the tie columns of rows with one time.  Same rows as
    ``cleaning.signature_dedup`` gives for all of them.
    """
    columns = ["us", *order, *[c for c in stream.columns if c not in order]]
    types = {f.name: f.dataType for f in stream.schema.fields} | {"us": T.LongType()}
    held = T.StructType([T.StructField(c, types[c]) for c in columns])
    out = T.StructType([T.StructField(c, types[c]) for c in stream.columns])
    return _grouped(stream, signature, ts, lateness, Thin(columns, held, len(order), interval_micros(horizon), stream.columns, signature), out)


def closing(df: DataFrame, ts: str, path: str, at: str = "2100-01-01") -> None:
    """Append to ``path`` a row of the shape of ``df`` at a time that closes everything before it; its other columns are null.

    Write it when all else has been read: it moves the watermark, and is never released itself.
    """
    schema = df.schema
    row = df.sparkSession.range(1).select(*[(F.lit(at) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.coalesce(1).write.mode("append").parquet(path)


def start(spark: SparkSession, begin: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with its state in RocksDB, leaving the session's own setting as it was."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return begin()
    finally:
        spark.conf.set(PROVIDER, before)
