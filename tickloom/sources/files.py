"""File scans and sinks: CSV, Parquet, JSON lines, directories."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import scalars as S
from tickloom.functions.checks import clean_row
from tickloom.plans.series import running
from tickloom.session import scratch_root

# Accepted names per field, matched without regard to case.
COLUMN_ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date_time", "ts", "date"),
    "price": ("price", "px", "close", "last", "mid_price", "midprice", "last_price", "lastprice", "bid_price_1", "ask_price_1", "mid"),
    "volume": ("volume", "vol", "size", "qty", "quantity", "last_volume", "lastvolume", "bid_volume_1", "ask_volume_1"),
    "side": ("side", "direction", "type"),
    "order_type": ("order_type", "ordertype", "type", "order_kind"),
    "order_id": ("order_id", "orderid", "id", "ref_id"),
    "symbol": ("symbol", "instrument", "ticker", "security"),
}
PRICE_WORDS = ("px", "price", "close", "last", "mid")
VOLUME_WORDS = ("vol", "size", "qty", "quantity", "amount")
PLAUSIBLE_PRICE = (0.001, 100000.0)
DEFAULT_VOLUME, DEFAULT_PRICE = 100, 100.0
DEFAULT_START = "2024-01-01 09:30:00"

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("aggregate_id", T.StringType()),
        T.StructField("aggregate_type", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("version", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
TICK_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("side", T.StringType()),
        T.StructField("order_type", T.StringType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("symbol", T.StringType()),
    ]
)


def derived_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def csv_scan(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], **options: str) -> DataFrame:
    """Delimited text with a header; every column as text, null tokens as null.

    ``columns`` are the file's columns in order, so no pass over the data is
    spent on inferring a schema; ``resolve_columns`` gives names and types.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path)
    return raw.select(*[S.null_tokens(f"`{c}`").alias(c) for c in columns])


def _read_by(df: DataFrame, column: Column) -> set[str]:
    """Columns of ``df`` that an expression reads."""
    found = df.select(column.alias("_c"))._jdf.queryExecution().analyzed().references().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().name())
    return names


def resolve_names(df: DataFrame, mapping: Mapping[str, str] | None = None, infer: bool = False, taken: Collection[str] = ()) -> dict[str, str]:
    """Standard field -> column of ``df``: the given mapping, known aliases, telling parts of names.

    With ``infer`` a price that no name tells is the one numeric column that holds
    plausible prices; if several do, that is an error, as a guess could take an
    account number.  Only this step reads data.  Columns ``taken`` for something
    else are left out.
    """
    found = {field: col for field, col in (mapping or {}).items() if col in df.columns}
    by_lower = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), c)
    for field, names in COLUMN_ALIASES.items():
        if field in found:
            continue
        for n in names:
            if n in by_lower and by_lower[n] not in found.values():
                found[field] = by_lower[n]
                break
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    free = [c for c in numeric if c not in found.values() and c not in taken]
    if "price" not in found:
        named = [c for c in free if any(w in c.lower() for w in PRICE_WORDS)]
        if named:
            found["price"] = named[0]
        elif free and infer:
            # One pass over the data for all columns.
            plausible = [F.count_if(F.col(c).between(*PLAUSIBLE_PRICE)).alias(c) for c in free]
            row = df.agg(*plausible).first()
            fit = [c for c in free if row[c]]
            if len(fit) > 1:
                raise ValueError(f"more than one column could be the price: {fit}; pass a mapping")
            found |= {"price": c for c in fit}
    free = [c for c in free if c not in found.values()]
    if "volume" not in found:
        named = [c for c in free if any(w in c.lower() for w in VOLUME_WORDS)]
        if named:
            found["volume"] = named[0]
    return found


def resolve_columns(
    df: DataFrame, mapping: Mapping[str, str] | None = None, row_index: Column | None = None, infer: bool = False
) -> DataFrame:
    """Rename to the standard fields, coerce types, fill in defaults: one projection.

    A missing time is start + ``row_index`` seconds, so it needs that column; what
    it reads is no other field.  See ``resolve_names`` for ``infer``.
    """
    found = resolve_names(df, mapping, infer, () if row_index is None else _read_by(df, row_index))
    out = []
    if "timestamp" in found:
        c = F.col(f"`{found['timestamp']}`")
        kind = df.schema[found["timestamp"]].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(c.cast("timestamp").alias("timestamp"))
        elif isinstance(kind, T.NumericType):
            out.append(S.epoch_time(c).alias("timestamp"))
        else:
            out.append(F.coalesce(S.parse_time(c), S.epoch_time(c.try_cast("long"))).alias("timestamp"))
    elif row_index is not None:
        start = F.unix_micros(F.lit(DEFAULT_START).cast("timestamp"))
        out.append(F.timestamp_micros(start + row_index.cast("long") * 1_000_000).alias("timestamp"))
    else:
        raise ValueError("no time column; pass row_index to make one")
    out.append(S.to_number(f"`{found['price']}`").alias("price") if "price" in found else F.lit(DEFAULT_PRICE).alias("price"))
    out.append(
        S.to_number(f"`{found['volume']}`").alias("volume") if "volume" in found
        else F.lit(float(DEFAULT_VOLUME)).alias("volume")
    )
    makers = {"side": S.side_code, "order_type": S.order_type_code,
              "order_id": lambda c: S.to_number(c, "long"), "symbol": lambda c: F.col(c)}
    for field, make in makers.items():
        if field in found:
            out.append(make(f"`{found[field]}`").alias(field))
    rest = [c for c in df.columns if c not in found.values()]
    return df.select(*out, *[F.col(f"`{c}`") for c in rest])


def dir_scan(spark: SparkSession, path: str, columns: Sequence[str], glob: str = "*.csv", name_from: str = "file") -> DataFrame:
    """All delimited files below ``path``; the symbol is the file (or folder) name up to the first underscore."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).options(header=True, pathGlobFilter=glob, recursiveFileLookup=True).csv(path)
    pattern = r"([^/_.]+)[^/]*$" if name_from == "file" else r"([^/_.]+)[^/]*/[^/]*$"
    name = F.upper(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    return raw.select(name.alias("symbol"), *[S.null_tokens(c).alias(c) for c in columns])


def name_parts(spark: SparkSession, folder: str, target: str, stem: str) -> None:
    """Move the data files of ``folder`` to ``target/<stem>_<number>.<extension>``, as other tools name their exports."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    source = path(folder)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    parts = sorted(s.getPath().getName() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    for k, name in enumerate(parts):
        if not fs.rename(path(folder, name), path(target, f"{stem}_{k:05d}.{name.rpartition('.')[2]}")):
            raise OSError(f"could not move {folder}/{name}")


def _fitted(field: T.StructField):
    """Text that is no number becomes null; a whole number too large for its column is an error, not a null."""
    column = F.col(field.name)
    return column.cast(field.dataType) if isinstance(field.dataType, T.LongType) else column.try_cast(field.dataType)


def write_tick_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Ticks with one stable schema, partitioned by date and sorted by symbol and time.

    Absent columns become null.  The range partitioning is balanced by sampling,
    so a large day or symbol is spread over tasks and files, and row groups hold
    few symbols each, which lets a symbol filter skip them.
    """
    have = set(df.columns)
    cols = [
        (_fitted(f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in TICK_SCHEMA.fields
    ]
    shaped = df.select(*cols).withColumn("date", F.to_date("timestamp"))
    (
        shaped.repartitionByRange("date", "symbol", "timestamp")
        .sortWithinPartitions("date", "symbol", "timestamp")
        .write.mode("errorifexists")
        .partitionBy("date")
        .option("compression", compression)
        .parquet(path)
    )


def read_tick_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType(TICK_SCHEMA.fields + [T.StructField("date", T.DateType())])).parquet(path)


def date_range(df: DataFrame, start: str, end: str, ts: str = "ts", date: str | None = None) -> DataFrame:
    """start <= ts < end + 1 day, with the same bounds on a ``date`` partition column if given."""
    last = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
    out = df.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < last))
    if date:
        out = out.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out


def file_metadata(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name, size, time, extension and speed class of the files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=True).load(path)
    mb = F.col("length") / F.lit(1024 * 1024)
    return files.select(
        F.col("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        F.when(mb < 10, "fast").when(mb < 100, "medium").otherwise("slow").alias("speed"),
    )


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("timestampFormat", JSON_TIME).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", JSON_TIME).json(path)


def write_results(df: DataFrame, path: str, by: str = "symbol") -> None:
    """Result rows as JSON, one folder per ``by`` value."""
    df.write.mode("errorifexists").partitionBy(by).json(path)


def metric_long(df: DataFrame, category: str, metrics: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Metric columns as (Category, Metric, Value) rows."""
    return df.unpivot(list(ids), list(metrics), "Metric", "Value").withColumn("Category", F.lit(category)).select(
        *ids, "Category", "Metric", "Value"
    )


GENERATED_RUN = 86_400


def _normal(seed: int, *key: str) -> Column:
    """Standard normal draw fixed by the key columns, so a repeated task draws the same."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(salt)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))

    return F.sqrt(F.log(uniform(1)) * -2) * F.cos(uniform(2) * F.lit(2 * math.pi))


def generate_ticks(
    plan: DataFrame, seed: int = 42, drift: float = 0.0, vol: float = 2e-4, rows_per_task: int | None = None
) -> DataFrame:
    """Seeded ticks, one a second, for a plan of (symbol, rows, start_price).

    A log-normal price path, a spread of 1.5 bps (0.01 at least), log-normal volume.
    """
    base = plan.filter("rows > 0").select(
        "symbol", "start_price", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / GENERATED_RUN))).alias("_run")
    ).repartition("symbol", "_run").select(
        # A row stands for a short run of ticks, so one symbol's ticks start in many tasks.
        "symbol", "start_price", F.explode(F.sequence(
            F.col("_run") * GENERATED_RUN, F.least((F.col("_run") + 1) * GENERATED_RUN, F.col("rows")) - 1
        )).alias("seq")
    ).select(
        "symbol", "start_price", "seq",
        F.timestamp_micros(F.unix_micros(F.lit(DEFAULT_START).cast("timestamp")) + F.col("seq") * 1_000_000).alias("ts"),
        (F.lit(drift) + F.lit(vol) * _normal(seed, "symbol", "seq")).alias("_step"),
        F.round(F.exp(F.lit(4.0) + _normal(seed + 1, "symbol", "seq") * F.lit(0.5))).alias("volume"),
    )
    path = running(base, {"_log": ("sum", F.col("_step"))}, rows_per_task=rows_per_task)
    price = F.col("start_price") * F.exp(F.col("_log"))
    half = F.greatest(price * F.lit(1.5e-4), F.lit(0.01)) / 2
    return path.select(
        "symbol", "ts", "seq", price.alias("price"), "volume", (price - half).alias("bid"), (price + half).alias("ask")
    )


def chunk_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Apply a pandas frame -> frame function batch by batch."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def standard_clean(df: DataFrame, **bounds) -> DataFrame:
    return df.filter(clean_row(ts="timestamp", **bounds))
