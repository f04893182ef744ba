"""Time-series features: a registry of named window expressions.

All requested features of a frame are built in two passes over one window
(helper columns, then the features), so they share one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import log_quotient, ratio, safe_divide
from tickloom.plans.decay import Decay, add_decays, by_span
from tickloom.plans.series import placed, running, windowed
from tickloom.plans.sliding import add_sliding

Build = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Feature:
    """A named column; ``back``/``ahead`` say how far its frame reaches from the row."""

    name: str
    build: Build
    back: int = 0
    ahead: int = 0
    needs: tuple[str, ...] = ()
    decays: tuple[Decay, ...] = field(default=())
    label: bool = False


def c(name: str) -> Column:
    return F.col(name)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


# Frames of at least so many rows are computed at a cost that does not grow with them.
WIDE = 20
_AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop}
_NAMES = {agg: name for name, agg in _AGGREGATES.items()}
# While ``compute`` builds features: the double columns there are, and the wide frames asked for.
_WIDE: ContextVar[tuple[set[str], dict[str, tuple[str, str, int]]] | None] = ContextVar("wide", default=None)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def full(agg: Callable[[Column], Column], x: str, n: int, w: WindowSpec) -> Column:
    """Aggregate of the last ``n`` rows, null until ``n`` values are there."""
    wide, kind = _WIDE.get(), "median" if agg is median else _NAMES.get(agg)
    # A median sorts its frame, so it gains from the start.
    if wide is not None and kind and x in wide[0] and n >= (2 if kind == "median" else WIDE):
        name = f"__{kind}_{x}_{n}"
        wide[1][name] = (kind, x, n)
        return c(name)
    frame = trailing(w, n)
    return F.when(F.count(x).over(frame) >= n, agg(c(x)).over(frame))


def frame_corr(a: str, b: str, frame: WindowSpec) -> Column:
    """Pearson correlation over a frame; null where one side does not vary (``corr`` fails there)."""
    both = c(a).isNotNull() & c(b).isNotNull()
    x, y = F.when(both, c(a)), F.when(both, c(b))
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    return ratio(F.covar_pop(x, y).over(frame), spread)


def _positive(x: Column) -> Column:
    return F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))


# Helper columns the features are built on: name -> (build, rows back).
HELPERS: dict[str, tuple[Build, int]] = {
    "_prev": (lambda w: F.lag("price").over(w), 1),
    "_diff": (lambda w: c("price") - F.lag("price").over(w), 1),
    "_ret": (lambda w: ratio("price", F.lag("price").over(w)) - 1, 1),
    "_gain": (lambda w: _positive(c("price") - F.lag("price").over(w)), 1),
    "_loss": (lambda w: _positive(F.lag("price").over(w) - c("price")), 1),
    "_notional": (lambda w: c("price") * c("volume"), 0),
    "_mid": (lambda w: (c("bid") + c("ask")) / 2, 0),
    "_spread": (lambda w: c("ask") - c("bid"), 0),
    "_imbalance": (lambda w: ratio(c("bid_volume") - c("ask_volume"), c("bid_volume") + c("ask_volume")), 0),
    "_side": (lambda w: F.when(c("side").isin("bid", "buy"), 1).when(c("side").isin("ask", "sell"), -1).otherwise(0), 0),
    "_dir": (lambda w: F.when(c("price") >= (c("bid") + c("ask")) / 2, 1).otherwise(-1), 0),
    "_up": (lambda w: F.coalesce((c("price") > F.lag("price").over(w)).cast("double"), F.lit(0.0)), 1),
}
# Helpers built from other helpers.
DERIVED: dict[str, tuple[Build, int, tuple[str, ...]]] = {
    "_ret2": (lambda w: c("_ret") * c("_ret"), 0, ("_ret",)),
    "_flow": (lambda w: c("_side") * c("volume"), 0, ("_side",)),
    "_buy": (lambda w: F.when(c("_side") > 0, c("volume")).otherwise(F.lit(0.0)), 0, ("_side",)),
    "_sell": (lambda w: F.when(c("_side") < 0, c("volume")).otherwise(F.lit(0.0)), 0, ("_side",)),
    "_dir_volume": (lambda w: c("_dir") * c("volume"), 0, ("_dir",)),
    **{f"_ret_lag_{k}": (lambda w, k=k: F.lag("_ret", k).over(w), k, ("_ret",)) for k in (1, 2, 5, 10)},
}

REGISTRY: dict[str, Feature] = {}


def register(name: str, build: Build, **how) -> None:
    """Add a named feature; ``build`` maps the window to a column."""
    REGISTRY[name] = Feature(name, build, **how)


def compute(df: DataFrame, features: Iterable[str | Feature], **series) -> DataFrame:
    """Add features by name or definition.

    Names without a definition become null columns.  Options of ``windowed``
    (keys, order, rows_per_task) pass through.
    """
    wanted, unknown = [], []
    for f in features:
        if isinstance(f, str):
            f = REGISTRY.get(f) or f
        (unknown if isinstance(f, str) else wanted).append(f)
    first: dict[str, Build] = {}
    second: dict[str, Build] = {}
    reach = 0
    for f in wanted:
        for n in f.needs:
            chain = (n,) if n in HELPERS else (*DERIVED[n][2], n)
            for m in chain:
                if m in HELPERS:
                    first[m] = HELPERS[m][0]
                else:
                    second[m] = DERIVED[m][0]
    helper_back = max([HELPERS[n][1] for n in first] + [0]) + max([DERIVED[n][1] for n in second] + [0])
    decays = {d.out: d for f in wanted for d in f.decays}
    decay_back = max([d.back for d in decays.values()] + [0])
    back = helper_back + decay_back + max([f.back for f in wanted] + [0])
    ahead = max([f.ahead for f in wanted] + [reach])

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        for stage in (first, second):
            if stage:
                d = d.withColumns({n: b(w) for n, b in stage.items()})
        if decays:
            d = add_decays(d, w, list(decays.values()))
        doubles = {f.name for f in d.schema.fields if isinstance(f.dataType, T.DoubleType)}
        narrow, built, wide = {}, {}, {}
        for f in wanted:
            own: dict[str, tuple[str, str, int]] = {}
            token = _WIDE.set((doubles, own))
            try:
                column = f.build(w)
            finally:
                _WIDE.reset(token)
            (built if own else narrow)[f.name] = column
            wide |= own
        # What needs the window comes first: the walk over wide frames keeps its rows, not its partitioning.
        d = d.withColumns(narrow)
        if wide:
            d = add_sliding(d, w, wide).withColumns(built)
        return d.drop(*first, *second, *decays, *wide)

    out = windowed(df, add, back=back, ahead=ahead, **series)
    return out.withColumns({n: F.lit(None).cast("double") for n in unknown}) if unknown else out


def safe_feature(name: str, build: Build, columns: Sequence[str], requires: Sequence[str], **how) -> Feature:
    """The feature, or a null column where a column it requires is missing."""
    if all(r in columns for r in requires):
        return Feature(name, build, **how)
    return Feature(name, lambda w: F.lit(None).cast("double"))


def _annual(x: Column, periods: float) -> Column:
    return x * F.lit(math.sqrt(periods))


register("price_change", lambda w: c("_diff"), needs=("_diff",))
register("price_change_pct", lambda w: c("_ret"), needs=("_ret",))
register("inter_arrival_ms", lambda w: (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / F.lit(1000.0), back=1)
register("trend_5", lambda w: F.coalesce(F.signum(c("price") - F.lag("price", 5).over(w)), F.lit(0.0)), back=5)

for n in (5, 10, 20, 30, 50, 100, 200):
    register(f"sma_{n}", lambda w, n=n: full(F.avg, "price", n, w), back=n)
    register(f"price_minus_sma_{n}", lambda w, n=n: c("price") - full(F.avg, "price", n, w), back=n)
for a, tag in ((0.1, "10"), (0.3, "30"), (0.5, "50")):
    d = Decay(f"_ema_{tag}", "price", a)
    register(f"ema_alpha_{tag}", lambda w, d=d: c(d.out), decays=(d,))
    register(f"price_minus_ema_{tag}", lambda w, d=d: c("price") - c(d.out), decays=(d,))
for n in (5, 10, 12, 20, 26, 50, 100, 200):
    d = by_span(f"_span_{n}", "price", n)
    register(f"ema_{n}", lambda w, d=d: c(d.out), decays=(d,))
    register(f"price_ema_ratio_{n}", lambda w, d=d: ratio("price", c(d.out)) - 1, decays=(d,))
for n in (5, 10, 20, 50, 100):
    register(f"momentum_{n}", lambda w, n=n: ratio("price", F.lag("price", n).over(w)) - 1, back=n)
    register(f"returns_{n}", lambda w, n=n: ratio("price", F.lag("price", n).over(w)) - 1, back=n)
    register(f"log_returns_{n}", lambda w, n=n: F.log(ratio("price", F.lag("price", n).over(w))), back=n)
    register(f"rolling_std_ret_{n}", lambda w, n=n: full(F.stddev_samp, "_ret", n, w), back=n, needs=("_ret",))
    register(f"volatility_{n}", lambda w, n=n: _annual(full(F.stddev_samp, "_ret", n, w), 252), back=n, needs=("_ret",))
    register(f"realized_vol_{n}", lambda w, n=n: F.sqrt(full(F.sum, "_ret2", n, w)), back=n, needs=("_ret2",))
    register(f"price_sma_ratio_{n}", lambda w, n=n: ratio("price", full(F.avg, "price", n, w)) - 1, back=n)
    register(f"price_std_{n}", lambda w, n=n: full(F.stddev_samp, "price", n, w), back=n)
    register(
        f"acceleration_{n}",
        lambda w, n=n: ratio("price", F.lag("price", n).over(w)) - ratio(F.lag("price").over(w), F.lag("price", n + 1).over(w)),
        back=n + 1,
    )
    register(f"volume_ma_{n}", lambda w, n=n: full(F.avg, "volume", n, w), back=n)
    register(f"volume_ratio_{n}", lambda w, n=n: ratio("volume", full(F.avg, "volume", n, w)), back=n)
    register(
        f"vwap_{n}", lambda w, n=n: ratio(full(F.sum, "_notional", n, w), full(F.sum, "volume", n, w)),
        back=n, needs=("_notional",),
    )
    register(
        f"price_vwap_ratio_{n}",
        lambda w, n=n: ratio("price", ratio(full(F.sum, "_notional", n, w), full(F.sum, "volume", n, w))) - 1,
        back=n, needs=("_notional",),
    )
    register(f"spread_ma_{n}", lambda w, n=n: full(F.avg, "_spread", n, w), back=n, needs=("_spread",))
    register(f"spread_std_{n}", lambda w, n=n: full(F.stddev_samp, "_spread", n, w), back=n, needs=("_spread",))
    register(f"bid_ask_imbalance_{n}", lambda w, n=n: full(F.avg, "_imbalance", n, w), back=n, needs=("_imbalance",))
    register(
        f"volume_zscore_{n}",
        lambda w, n=n: ratio(c("volume") - full(F.avg, "volume", n, w), full(F.stddev_samp, "volume", n, w)), back=n,
    )
    register(f"order_flow_{n}", lambda w, n=n: full(F.sum, "_dir_volume", n, w), back=n, needs=("_dir_volume",))
    register(f"direction_sum_{n}", lambda w, n=n: full(F.sum, "_dir", n, w), back=n, needs=("_dir",))
    register(f"trade_intensity_{n}", lambda w, n=n: full(F.sum, "volume", n, w), back=n)
    register(f"signed_flow_{n}", lambda w, n=n: full(F.sum, "_flow", n, w), back=n, needs=("_flow",))
    register(
        f"flow_ratio_{n}", lambda w, n=n: safe_divide(full(F.sum, "_flow", n, w), full(F.sum, "volume", n, w)),
        back=n, needs=("_flow",),
    )
    register(
        f"buy_sell_ratio_{n}", lambda w, n=n: safe_divide(full(F.sum, "_buy", n, w), full(F.sum, "_sell", n, w)),
        back=n, needs=("_buy", "_sell"),
    )
register("high_20", lambda w: full(F.max, "price", 20, w), back=20)
register("low_20", lambda w: full(F.min, "price", 20, w), back=20)
register(
    "high_low_vol", lambda w: safe_divide(full(F.max, "price", 20, w) - full(F.min, "price", 20, w), "price"), back=20
)
register("signed_volume", lambda w: c("_flow"), needs=("_flow",))
register("spread", lambda w: c("_spread"), needs=("_spread",))
register("spread_pct", lambda w: ratio("_spread", "_mid"), needs=("_spread", "_mid"))
register("mid_price", lambda w: c("_mid"), needs=("_mid",))
register("price_vs_mid", lambda w: ratio("price", "_mid") - 1, needs=("_mid",))
register("spread_volatility", lambda w: full(F.stddev_samp, "_spread", 20, w), back=20, needs=("_spread",))
for k, tag in ((1.0, "1"), (2.0, "2"), (2.5, "25")):
    for n in (10, 20, 50):
        mean, dev = (lambda w, n=n: full(F.avg, "price", n, w)), (lambda w, n=n: full(F.stddev_samp, "price", n, w))
        register(f"bb_upper_{n}_{tag}", lambda w, m=mean, s=dev, k=k: m(w) + F.lit(k) * s(w), back=n)
        register(f"bb_lower_{n}_{tag}", lambda w, m=mean, s=dev, k=k: m(w) - F.lit(k) * s(w), back=n)
        register(
            f"bb_position_{n}_{tag}",
            lambda w, m=mean, s=dev, k=k: ratio(c("price") - m(w) + F.lit(k) * s(w), F.lit(2 * k) * s(w)), back=n,
        )
for n in (5, 10, 14, 20, 21, 30, 50):
    def _rsi(w: WindowSpec, n: int = n) -> Column:
        gain, loss = full(F.avg, "_gain", n, w), full(F.avg, "_loss", n, w)
        return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(F.lit(100.0) - F.lit(100.0) / (1 + gain / loss))

    register(f"rsi_{n}", _rsi, back=n, needs=("_gain", "_loss"))
register("trade_direction", lambda w: c("_dir"), needs=("_dir",))
register("tick_direction", lambda w: F.signum("_diff"), needs=("_diff",))
register("uptick_ratio_20", lambda w: full(F.avg, "_up", 20, w), back=20, needs=("_up",))


def _jump(w: WindowSpec) -> Column:
    return F.coalesce(F.abs(c("_ret")) > 3 * full(F.stddev_samp, "_ret", 50, w), F.lit(False))


register("jump_indicator", lambda w: _jump(w).cast("int"), back=50, needs=("_ret",))
register("jump_size", lambda w: F.when(_jump(w), F.abs(c("_ret"))).otherwise(F.lit(0.0)), back=50, needs=("_ret",))
for k in (1, 2, 5, 10):
    register(
        f"autocorr_{k}",
        lambda w, k=k: F.when(
            F.count("_ret").over(trailing(w, 50)) >= 50, frame_corr("_ret", f"_ret_lag_{k}", trailing(w, 50 - k))
        ),
        back=50, needs=("_ret", f"_ret_lag_{k}"),
    )


def _unbiased_skew(x: str, n: int, w: WindowSpec) -> Column:
    return full(F.skewness, x, n, w) * F.lit(math.sqrt(n * (n - 1)) / (n - 2))


def _unbiased_kurtosis(x: str, n: int, w: WindowSpec) -> Column:
    return ((n + 1) * full(F.kurtosis, x, n, w) + 6) * F.lit((n - 1) / ((n - 2) * (n - 3)))


for n in (20, 50):
    register(f"skewness_{n}", lambda w, n=n: _unbiased_skew("_ret", n, w), back=n, needs=("_ret",))
    register(f"kurtosis_{n}", lambda w, n=n: _unbiased_kurtosis("_ret", n, w), back=n, needs=("_ret",))
for h in (1, 2, 3, 5, 10):
    register(
        f"price_impact_{h}", lambda w, h=h: ratio(F.lead("price", h).over(w), "price") - 1, ahead=h, label=True
    )
register("annualised_vol", lambda w: _annual(full(F.stddev_pop, "_ret", 19, w), 252 * 390), back=19, needs=("_ret",))


def _z_anomaly(w: WindowSpec) -> Column:
    return ratio(c("_ret") - full(F.avg, "_ret", 20, w), full(F.stddev_samp, "_ret", 20, w))


register("return_z", _z_anomaly, back=20, needs=("_ret",))
register("return_anomaly", lambda w: F.coalesce(F.abs(_z_anomaly(w)) > 3, F.lit(False)), back=20, needs=("_ret",))


def _volume_z(w: WindowSpec) -> Column:
    past = w.rowsBetween(-49, -1)
    sd = F.stddev_pop("volume").over(past)
    z = F.when(sd == 0, F.lit(0.0)).otherwise((c("volume") - F.avg("volume").over(past)) / sd)
    return F.when(F.count("volume").over(past) >= 10, z)


register("volume_anomaly_z", _volume_z, back=49)
register("price_spike", lambda w: F.coalesce(F.abs(c("_ret")) > 0.05, F.lit(False)), needs=("_ret",))
register(
    "spike_direction",
    lambda w: F.when(c("_ret") > 0.05, "up").when(c("_ret") < -0.05, "down"), needs=("_ret",),
)
register(
    "last_100_vwap",
    lambda w: ratio(F.sum("_notional").over(trailing(w, 100)), F.sum("volume").over(trailing(w, 100))),
    back=100, needs=("_notional",),
)


def model_inputs() -> list[str]:
    """Registered names fit for a model: those that do not look ahead."""
    return [n for n, f in REGISTRY.items() if not f.label]


def macd_hist(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "price", **series) -> DataFrame:
    """EMA(fast) - EMA(slow) minus the signal EMA of that difference."""
    a, b = by_span("_fast", price, fast), by_span("_slow", price, slow)
    line = by_span("_signal", "_line", signal)

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = add_decays(d, w, [a, b]).withColumn("_line", c("_fast") - c("_slow"))
        d = add_decays(d, w, [line])
        return d.withColumn(f"macd_hist_{fast}_{slow}_{signal}", c("_line") - c("_signal")).drop(
            "_fast", "_slow", "_line", "_signal"
        )

    return windowed(df, add, back=max(a.back, b.back) + line.back, **series)


def cumulative_volume(df: DataFrame, **series) -> DataFrame:
    return running(df, {"cumulative_volume": ("sum", c("volume"))}, **series)


def running_vwap(df: DataFrame, **series) -> DataFrame:
    both = running(df, {"_cn": ("sum", c("price") * c("volume")), "_cv": ("sum", c("volume"))}, **series)
    return both.withColumn("running_vwap", ratio("_cn", "_cv")).drop("_cn", "_cv")


def forward_fill(df: DataFrame, columns: Sequence[str], default: float = 0.0, **series) -> DataFrame:
    """Last known value per key, ``default`` before the first."""
    filled = running(df, {f"_f_{n}": ("last", c(n)) for n in columns}, **series)
    return filled.withColumns({n: F.coalesce(f"_f_{n}", F.lit(default)) for n in columns}).drop(
        *[f"_f_{n}" for n in columns]
    )


def rolling_statistics(df: DataFrame, column: str, n: int, stats: Sequence[str] = ("mean", "std", "min", "max", "median"), **series) -> DataFrame:
    makers = {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "median": median,
    }
    return compute(df, [Feature(f"{column}_{s}_{n}", lambda w, s=s: full(makers[s], column, n, w), back=n) for s in stats], **series)


def rolling_correlation(df: DataFrame, a: str, b: str, n: int = 100, **series) -> DataFrame:
    """Correlation of two columns over the last ``n`` rows; 0 while undefined."""

    def build(w: WindowSpec) -> Column:
        return F.coalesce(frame_corr(a, b, trailing(w, n)), F.lit(0.0))

    return compute(df, [Feature("rolling_corr", build, back=n)], **series)


def lag_features(df: DataFrame, target: str = "price", horizon: int = 5, **series) -> DataFrame:
    """Lags and shifted rolling statistics of the target plus its future value; rows with nulls removed."""
    out = [Feature(f"{target}_lag_{k}", lambda w, k=k: F.lag(target, k).over(w), back=k) for k in (1, 2, 3, 5, 10)]

    def shifted(agg, x: str, n: int) -> Build:
        return lambda w: F.when(
            F.count(x).over(w.rowsBetween(-n, -1)) >= n, agg(c(x)).over(w.rowsBetween(-n, -1))
        )

    for n in (5, 10, 20):
        for label, agg in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out.append(Feature(f"{target}_{label}_{n}", shifted(agg, target, n), back=n))
    out.append(Feature("volume_lag_1", lambda w: F.lag("volume").over(w), back=1))
    out.append(Feature("volume_mean_10", shifted(F.avg, "volume", 10), back=10))
    if "bid" in df.columns and "ask" in df.columns:
        out.append(Feature("spread_lag_1", lambda w: F.lag("_spread").over(w), back=1, needs=("_spread",)))
    out.append(
        Feature(
            "order_flow_lag_1",
            lambda w: F.when(F.count("_flow").over(w.rowsBetween(-10, -1)) >= 10, F.sum("_flow").over(w.rowsBetween(-10, -1))),
            back=10, needs=("_flow",),
        )
    )
    out.append(Feature("target", lambda w: F.lead(target, horizon).over(w), ahead=horizon))
    names = [f.name for f in out]
    timed = compute(df, out, **series).withColumns(
        {"hour": F.hour("ts"), "minute": F.minute("ts"), "day_of_week": F.weekday("ts")}
    )
    return timed.dropna(subset=names)


def forward_label(df: DataFrame, horizon: int = 5, **series) -> DataFrame:
    """Future price, size of the log return (infinite from or to zero) and its 0/1 direction; the tail without a future is removed."""
    out = compute(df, [Feature("target", lambda w: F.lead("price", horizon).over(w), ahead=horizon)], **series)
    r = log_quotient("target", "price")
    return out.dropna(subset=["target"]).withColumns({"magnitude": F.abs(r), "direction": (r > 0).cast("int")})


def interval_gaps(df: DataFrame, expected_ms: float, **series) -> DataFrame:
    """Pauses longer than 1.5 times the expected interval."""
    prev = Feature("gap_start", lambda w: F.lag("ts").over(w), back=1)
    ms = (F.unix_micros("ts") - F.unix_micros("gap_start")) / F.lit(1000.0)
    return compute(df, [prev], **series).withColumn("gap_ms", ms).filter(c("gap_ms") > F.lit(1.5 * expected_ms)).withColumn(
        "gap_end", c("ts")
    )


def sessions(df: DataFrame, gap_seconds: float = 3600.0, keys: Sequence[str] = ("symbol",), **series) -> DataFrame:
    """Sessions split by pauses: start, end, rows per session."""
    gap = int(gap_seconds * 1e6)

    def opens(w: WindowSpec) -> Column:
        pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
        return F.coalesce((pause >= gap).cast("int"), F.lit(1))

    marked = compute(placed(df, keys=keys, **series), [Feature("_opens", opens, back=1)], keys=keys, **series)
    ided = running(marked, {"session": ("sum", c("_opens"))}, keys=keys, **series)
    return ided.groupBy(*keys, "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("rows")
    )
