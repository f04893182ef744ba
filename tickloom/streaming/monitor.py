"""De-duplication, validation, windows, quality metrics and alerts on event time.

Every function takes a batch or a streaming frame; watermarks only matter on
the latter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.checks import all_of
from tickloom.functions.scalars import symbol_code
from tickloom.operators.cleaning import signature_dedup
from tickloom.streaming.ordered import LATENESS, interval_micros, thinned

# Weights of the quality score, its grades, and the advice thresholds.
SCORE_WEIGHTS = {"latency": 0.25, "error": 0.20, "validation": 0.20, "uptime": 0.20, "staleness": 0.15}
GRADES = ((90, "EXCELLENT"), (80, "GOOD"), (70, "FAIR"))
ALERT_LIMITS = {"drawdown": 0.10, "volatility": 0.30, "risk_events": 5}
MUTE = "5 minutes"
SKETCH_K = 800
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def dedup(
    events: DataFrame, signature: Sequence[str], ts: str = "ts", horizon: str = LATENESS, order: Sequence[str] = ("seq",), lateness: str = LATENESS
) -> DataFrame:
    """Drop a row if the last kept row of its signature is at most ``horizon`` earlier.

    A batch and a stream keep the same rows, as the stream takes them in the order
    of time, then ``order``; rows later than ``lateness`` are dropped and counted.
    Start a stream with ``ordered.start``.
    """
    if events.isStreaming:
        return thinned(events, signature, horizon, order, ts, lateness)
    return signature_dedup(events, signature, interval_micros(horizon) / 1_000_000, order=(ts, *order), ts=ts)


def normalised(events: DataFrame) -> DataFrame:
    return events.withColumns({"symbol": symbol_code("symbol"), "price": F.col("price").cast("double"), "quantity": F.col("quantity").cast("double")})


def validity(events: DataFrame) -> DataFrame:
    """Add ``fault``: the first rule a message breaks, null when it passes."""
    p, q = F.col("price"), F.col("quantity")
    fault = (
        F.when(~all_of(F.length("symbol") > 0, F.col("ts").isNotNull()), "missing field")
        .when(p.isNotNull() & ~((p > 0) & (p <= 1_000_000)), "price")
        .when(q < 0, "quantity")
    )
    return events.withColumn("fault", fault)


def throughput(events: DataFrame, ts: str = "ts", span: str = "60 seconds", slide: str = "10 seconds", lateness: str = LATENESS, failed: Column | None = None, latency: str | None = None) -> DataFrame:
    """Messages, failures, rate per second and mean latency per sliding window."""
    failed = F.lit(False) if failed is None else failed
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / F.lit(1e6)
    out = events.withWatermark(ts, lateness).groupBy(F.window(ts, span, slide).alias("w")).agg(
        F.count("*").alias("messages"), F.count_if(failed).alias("failed"),
        (F.avg(latency) if latency else F.lit(None).cast("double")).alias("avg_latency"),
    )
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages", "failed", "avg_latency", (F.col("messages") / seconds).alias("per_second"))


def latency_windows(
    events: DataFrame, latency: str, ts: str = "ts", span: str = "1 minute", lateness: str = LATENESS, k: int = SKETCH_K
) -> DataFrame:
    """Count, mean, maximum and a mergeable quantile sketch of latency per tumbling window; see ``with_percentiles``, ``merged_latency``."""
    out = events.withWatermark(ts, lateness).groupBy(F.window(ts, span).alias("w")).agg(
        F.count("*").alias("n"), F.avg(latency).alias("avg"), F.max(latency).alias("max"),
        F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"),
    )
    return out.select(F.col("w.start").alias("start"), "n", "avg", "max", "sketch")


def rank_bound(k: int = SKETCH_K) -> float:
    """Share of the values by which the rank of a sketch's quantile may be off, in 99 of 100 cases (published fit for one rank)."""
    return 2.296 / k**0.9723


def with_percentiles(windows: DataFrame, probs: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """Percentiles from the column ``sketch``: the least value whose share of values up to it reaches the probability.

    Windows of at most ``k`` values are exact; larger ones are off by ``rank_bound`` of their rows at most.
    """
    found = {n: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for n, p in probs.items()}
    return windows.withColumns(found)


def merged_latency(windows: DataFrame, keys: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Latency over several windows, from their counts, means and sketches alone."""
    return windows.groupBy(*keys).agg(
        (F.sum(F.col("avg") * F.col("n")) / F.sum("n")).alias("avg"), F.max("max").alias("max"), F.sum("n").alias("n"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def last_updates(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Newest time per symbol; as a stream, an update-mode aggregate."""
    return events.groupBy("symbol").agg(F.max(ts).alias("last_ts"))


def staleness(last: DataFrame, now: Column | None = None) -> DataFrame:
    """Largest and mean age in seconds of the last updates against ``now`` (the newest of them if omitted)."""
    top = last.agg(F.max("last_ts").alias("_now"))
    at = F.col("_now") if now is None else now
    age = (F.unix_micros(at) - F.unix_micros("last_ts")) / F.lit(1e6)
    return last.crossJoin(F.broadcast(top)).agg(F.count("*").alias("symbols"), F.max(age).alias("staleness_seconds"), F.avg(age).alias("mean_age_seconds"))


def rates(events: DataFrame, signature: Sequence[Column], fault: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Messages and the shares of repeats, faults and passes; repeats follow from counts per signature."""
    each = events.groupBy(*keys, *[c.alias(f"_g{i}") for i, c in enumerate(signature)]).agg(
        F.count("*").alias("_n"), F.count_if(fault).alias("_bad")
    )
    n = F.sum("_n")
    return each.groupBy(*keys).agg(
        n.alias("messages"), ((n - F.count("*")) / n).alias("duplicate_rate"), (F.sum("_bad") / n).alias("error_rate"),
        (1 - F.sum("_bad") / n).alias("pass_rate"),
    )


def uptime(events: DataFrame, ts: str = "ts", seconds: int = 10) -> DataFrame:
    """Share in percent of the time slices, from the first to the last, that hold data."""
    slot = F.floor(F.unix_micros(ts) / (seconds * 1_000_000))
    slots = events.groupBy(slot.alias("_s")).agg(F.lit(1).alias("_one"))
    return slots.agg((F.count("*") / (F.max("_s") - F.min("_s") + 1) * 100).alias("uptime_pct"))


def quality_score(metrics: DataFrame) -> DataFrame:
    """Score 0-100, grade and advice from latency_p95, error_rate, pass_rate, uptime_pct, staleness_seconds, per_second."""
    c = F.col
    parts = {
        "latency": F.greatest(F.lit(0.0), 100 - c("latency_p95") / 10),
        "error": F.greatest(F.lit(0.0), 100 - c("error_rate") * 1000),
        "validation": c("pass_rate") * 100,
        "uptime": c("uptime_pct"),
        "staleness": F.greatest(F.lit(0.0), 100 - c("staleness_seconds") / 5),
    }
    total = sum((v * F.lit(SCORE_WEIGHTS[n]) for n, v in parts.items()), F.lit(0.0))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))
    grade = F.when(F.lit(False), "")
    for least, name in GRADES:
        grade = grade.when(c("quality_score") >= least, name)
    advice = F.array_compact(
        F.array(
            F.when(c("latency_p95") > 500, "reduce latency"), F.when(c("error_rate") > 0.05, "review errors"),
            F.when(c("pass_rate") < 0.95, "check source data"), F.when(c("staleness_seconds") > 60, "check subscriptions"),
            F.when(c("per_second") < 1.0, "low message rate"),
        )
    )
    return metrics.withColumn("quality_score", score).withColumns({"status": grade.otherwise("POOR"), "advice": advice})


def alerts(metrics: DataFrame) -> DataFrame:
    """One row per limit broken: ts, source, title, value, limit (columns drawdown, volatility, risk_events)."""
    rules = F.array_compact(
        F.array(
            *[
                F.when(F.col(name) > limit, F.struct(F.lit(name).alias("title"), F.col(name).cast("double").alias("value"), F.lit(float(limit)).alias("limit")))
                for name, limit in ALERT_LIMITS.items()
            ]
        )
    )
    return metrics.select("ts", "source", F.explode(rules).alias("a")).select("ts", "source", "a.*")


def muted(raised: DataFrame, mute: str = MUTE) -> DataFrame:
    """The same alert (title, source) once per mute period."""
    if not raised.isStreaming:
        raise ValueError("muting works on event time of a stream")
    return raised.withWatermark("ts", mute).dropDuplicatesWithinWatermark(["title", "source"])


def event_bars(ticks: DataFrame, span: str, slide: str | None = None, session_gap: str | None = None, lateness: str = LATENESS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """OHLC, volume and count per tumbling, sliding or session window on event time; later rows are dropped."""
    w = F.session_window("ts", session_gap) if session_gap else F.window("ts", span, slide or span)
    at = F.struct("ts", "seq")
    out = ticks.withWatermark("ts", lateness).groupBy(*keys, w.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades"),
    )
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "trades")


def replay(spark, path: str, schema, start: Column | None = None, end: Column | None = None, files_per_batch: int = 8) -> DataFrame:
    """A stored JSON log as a stream, optionally cut to a time range."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    if end is not None:
        out = out.filter(F.col("ts") <= end)
    return out
