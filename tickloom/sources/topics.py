"""Topics: names, routing and a source/sink factory (Kafka, or files where no broker is at hand)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Topic names by family and message kind.
TOPICS = {
    "market": {"level1": "market-data-level1", "level2": "market-data-level2", "trades": "market-data-trades"},
    "order": {"request": "order-requests", "execution": "order-executions", "update": "order-updates"},
    "strategy": {"signal": "strategy-signals", "position": "strategy-positions", "pnl": "strategy-pnl"},
    "risk": {"alert": "risk-alerts", "limit": "risk-limits"},
    "system": {"health": "system-health", "alert": "system-alerts"},
}
FALLBACK = {"market": "level1", "order": "request"}
MESSAGE_SCHEMA = "topic string, key string, value string, timestamp timestamp"


def topic_of(family: str, kind: Column) -> Column:
    """Topic for a message kind; unknown market and order kinds go to the family's first topic."""
    names = TOPICS[family]
    out = F.when(F.lit(False), "")
    for k, t in names.items():
        out = out.when(kind == k, t)
    return out.otherwise(F.lit(names[FALLBACK[family]]) if family in FALLBACK else F.lit(None))


def to_messages(df: DataFrame, topic: Column, key: Column, ts: str = "ts") -> DataFrame:
    """(topic, key, value, timestamp) rows with the whole row as JSON value."""
    return df.select(
        topic.alias("topic"), key.cast("string").alias("key"),
        F.to_json(F.struct(*df.columns)).alias("value"), F.col(ts).cast("timestamp").alias("timestamp"),
    )


def from_messages(df: DataFrame, schema: str) -> DataFrame:
    return df.select("topic", "key", F.from_json(F.col("value").cast("string"), schema).alias("_v")).select(
        "topic", "key", "_v.*"
    )


def read_topics(spark: SparkSession, topics: list[str], *, servers: str | None = None, folder: str | None = None,
                starting: str = "earliest") -> DataFrame:
    """Streaming (topic, key, value, timestamp) rows."""
    if servers:
        raw = (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(topics)).option("startingOffsets", starting).load()
        )
        return raw.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")
    return spark.readStream.schema(MESSAGE_SCHEMA).json(folder).filter(F.col("topic").isin(*topics))


def write_topics(df: DataFrame, *, checkpoint: str, servers: str | None = None, folder: str | None = None) -> DataStreamWriter:
    out = df.writeStream.option("checkpointLocation", checkpoint)
    if servers:
        return out.format("kafka").option("kafka.bootstrap.servers", servers)
    return out.format("json").option("path", folder)
