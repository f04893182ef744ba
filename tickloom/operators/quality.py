"""Data-quality rules: one flag column per rule, summed up in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.checks import ORDER_TYPES, PRICE_BOUNDS, SIDES, VOLUME_BOUNDS
from tickloom.plans.series import broadcast_if_small, quantiles, windowed

# Columns a tick table must or may have, and rule thresholds.
REQUIRED = ("timestamp", "price", "volume")
OPTIONAL = ("side", "order_type", "order_id", "symbol")
GAP_SECONDS = 3600
WIDE_SPREAD = 0.1
MIN_TICK = 0.001
MAX_RETURN_STD = 0.5
MODIFIED_Z, IQR_FENCE = 5.0, 5.0
MAX_LEVELS = 1000


def schema_report(df: DataFrame) -> DataFrame:
    """Required, optional and unexpected columns: presence, type, values and nulls of each."""
    types = dict(df.dtypes)
    names = [(c, "required") for c in REQUIRED] + [(c, "optional") for c in OPTIONAL]
    names += [(c, "unexpected") for c in df.columns if c not in REQUIRED + OPTIONAL]
    counts = df.agg(F.count("*").alias("rows"), *[F.count(f"`{c}`").alias(f"v_{i}") for i, (c, _) in enumerate(names) if c in types])
    each = [
        F.struct(
            F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.lit(c in types).alias("present"),
            F.lit(types.get(c)).cast("string").alias("type"), (F.col(f"v_{i}") if c in types else F.lit(0)).cast("long").alias("n_values"),
            (F.col("rows") - F.col(f"v_{i}") if c in types else F.col("rows")).cast("long").alias("n_nulls"),
        )
        for i, (c, kind) in enumerate(names)
    ]
    return counts.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def _bad(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def type_flags(price: str = "price", volume: str = "volume", ts: str = "timestamp") -> dict[str, Column]:
    """Values that do not parse, from text columns."""
    def unparsed(name: str, kind: str) -> Column:
        return F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()

    return {
        "bad_price_type": unparsed(price, "double"), "bad_volume_type": unparsed(volume, "double"),
        "bad_time": unparsed(ts, "timestamp"),
    }


def range_flags(price: str = "price", volume: str = "volume") -> dict[str, Column]:
    p, v = F.col(price), F.col(volume)
    return {
        "negative_prices": _bad(p < 0), "zero_prices": _bad(p == 0), "high_prices": _bad(p > PRICE_BOUNDS[1]),
        "low_prices": _bad((p > 0) & (p < PRICE_BOUNDS[0])), "negative_volumes": _bad(v < 0),
        "zero_volumes": _bad(v == 0), "high_volumes": _bad(v > VOLUME_BOUNDS[1]),
    }


def missing_flags(columns: Sequence[str], critical: Sequence[str]) -> dict[str, Column]:
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNull()
    return {f"missing_{c}": F.col(c).isNull() for c in critical} | {"empty_rows": every}


def enum_flags(order_type: str | None = "order_type", side: str | None = "side") -> dict[str, Column]:
    out = {}
    if order_type:
        out["bad_order_type"] = _bad(~F.col(order_type).isin(*ORDER_TYPES))
    if side:
        out["bad_side"] = _bad(~F.col(side).isin(*SIDES))
    return out


def count_flags(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows each rule marks."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def offenders(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values outside the allowed ones with their counts (a table, so of any size)."""
    return df.filter(~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def _book_sides(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best bid and ask per group, combined before the shuffle; only literal bid/ask count."""
    return df.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"),
        F.count("*").alias("rows"),
    )


def crossed(df: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Groups whose best bid is above the best ask; all their rows are bad."""
    return _book_sides(df, keys).filter(F.col("best_bid") > F.col("best_ask"))


def wide_spread(df: DataFrame, keys: Sequence[str] = ("symbol", "ts"), share: float = WIDE_SPREAD) -> DataFrame:
    """Groups, not crossed, with a spread above ``share`` of the mid."""
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    spread = F.try_divide(F.col("best_ask") - F.col("best_bid"), mid)
    return _book_sides(df, keys).withColumn("relative_spread", spread).filter(
        (F.col("best_ask") > F.col("best_bid")) & (F.col("relative_spread") > share)
    )


def temporal_report(
    df: DataFrame, ts: str = "ts", seq: str = "seq", keys: Sequence[str] = ("symbol",), now: Column | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Per key: missing times, rows earlier than their predecessor in ingest order, repeats, long gaps, future rows."""
    us = F.unix_micros(ts)

    def by_ingest(d, w):
        return d.withColumn("_unsorted", _bad(us < F.lag(us).over(w)))

    def by_time(d, w):
        step = us - F.lag(us).over(w)
        return d.withColumns({"_repeat": _bad(step == 0), "_gap": _bad(step > GAP_SECONDS * 1_000_000)})

    seen = windowed(df, by_ingest, keys=keys, order=(seq,), back=1, rows_per_task=rows_per_task)
    seen = windowed(seen, by_time, keys=keys, order=(ts, seq), back=1, rows_per_task=rows_per_task)
    future = _bad(F.col(ts) > now) if now is not None else F.lit(False)
    return seen.groupBy(*keys).agg(
        F.count_if(F.col(ts).isNull()).alias("invalid"), F.count_if("_unsorted").alias("unsorted"),
        F.count_if("_repeat").alias("duplicates"), F.count_if("_gap").alias("gaps"), F.count_if(future).alias("future"),
    )


def microstructure_report(df: DataFrame, keys: Sequence[str] = ("symbol",), **series) -> DataFrame:
    """Per key: smallest price step, deviation of returns and the two warnings."""

    def add(d, w):
        prev = F.lag("price").over(w)
        return d.withColumns({"_step": F.abs(F.col("price") - prev), "_ret": F.try_divide(F.col("price"), prev) - 1})

    out = windowed(df, add, keys=keys, back=1, **series).groupBy(*keys).agg(
        F.min(F.when(F.col("_step") > 1e-12, F.col("_step"))).alias("min_tick"),
        F.stddev_samp("_ret").alias("return_std"), F.count("*").alias("rows"),
    )
    return out.withColumns(
        {
            "tiny_tick": _bad(F.col("min_tick") < MIN_TICK),
            "volatile": _bad((F.col("rows") > 100) & (F.col("return_std") > MAX_RETURN_STD)),
        }
    )


def outlier_flags(
    df: DataFrame, column: str, method: str = "modified_z", threshold: float = 5.0, keys: Sequence[str] = ("symbol",),
    name: str = "is_outlier", rows_per_task: int | None = None,
) -> DataFrame:
    """Flag outliers per key by modified z (median and MAD), IQR fence or plain z; zero scale flags nothing."""
    x = F.col(column)
    if method == "z":
        stats = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
        far = F.try_divide(F.abs(x - F.col("_m")), F.col("_s")) > threshold
    elif method == "iqr":
        stats = quantiles(df, column, {"_m": 0.25, "_s": 0.75}, keys=keys, rows_per_task=rows_per_task)
        width = (F.col("_s") - F.col("_m")) * threshold
        far = (x < F.col("_m") - width) | (x > F.col("_s") + width)
    else:
        med = quantiles(df, column, {"_m": 0.5}, keys=keys, rows_per_task=rows_per_task)
        dev = df.join(broadcast_if_small(med), list(keys)).withColumn("_d", F.abs(x - F.col("_m")))
        mad = quantiles(dev, "_d", {"_s": 0.5}, keys=keys, rows_per_task=rows_per_task)
        stats = med.join(mad, list(keys))
        far = F.try_divide(F.lit(0.6745) * F.abs(x - F.col("_m")), F.col("_s")) > threshold
    return df.join(broadcast_if_small(stats), list(keys), "left").withColumn(name, _bad(far)).drop("_m", "_s")


def book_structure(df: DataFrame, keys: Sequence[str] = ("symbol", "ts"), most: int = MAX_LEVELS) -> DataFrame:
    """Per group: whether each side is there, level count and the too-many flag, for every timestamp."""
    return df.groupBy(*keys).agg(
        F.max((F.col("side") == "bid").cast("int")).alias("has_bids"),
        F.max((F.col("side") == "ask").cast("int")).alias("has_asks"),
        F.count("*").alias("levels"), (F.count("*") > most).alias("too_many"),
    )


def summary(df: DataFrame, errors: Mapping[str, Column], warnings: Mapping[str, Column]) -> DataFrame:
    """(rule, level, n) rows plus totals; valid rows are those without any error, so none is counted twice."""
    any_error = F.lit(False)
    for c in errors.values():
        any_error = any_error | _bad(c)
    one = df.agg(
        F.count("*").alias("total_rows"), F.count_if(~any_error).alias("valid_rows"),
        *[F.count_if(c).alias(n) for n, c in {**errors, **warnings}.items()],
    )
    long = one.unpivot([], one.columns, "rule", "n")
    level = F.when(F.col("rule").isin(*errors), "error").when(F.col("rule").isin(*warnings), "warning").otherwise("total")
    return long.select("rule", level.alias("level"), "n")


def profile(df: DataFrame, price: str = "price", volume: str = "volume", ts: str = "ts", rows_per_task: int | None = None) -> DataFrame:
    """One row: counts, nulls, price and volume statistics, time span."""
    p, v = F.col(price), F.col(volume)
    stats = df.agg(
        F.count("*").alias("rows"), F.count_if(p.isNull() | v.isNull()).alias("null_rows"),
        F.min(p).alias("price_min"), F.max(p).alias("price_max"), F.avg(p).alias("price_mean"),
        F.stddev_samp(p).alias("price_std"), F.sum(v).alias("volume_sum"), F.avg(v).alias("volume_mean"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )
    median = quantiles(df, volume, {"volume_median": 0.5}, keys=(), rows_per_task=rows_per_task)
    return stats.crossJoin(F.broadcast(median))


def observed(df: DataFrame, name: str, keep: Column):
    """Filter with counters on the side: (filtered frame, observation of rows seen and dropped)."""
    from pyspark.sql import Observation

    watch = Observation(name)
    seen = df.observe(watch, F.count("*").alias("loaded"), F.count_if(~_bad(keep)).alias("dropped"))
    return seen.filter(keep), watch
