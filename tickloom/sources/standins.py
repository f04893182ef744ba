"""The star-schema test tables seen as ticks, quotes, trades and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_ORDER = ("ts", "order_id", "line_no", "volume", "price", "discount", "tax", "flag", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: price, volume, side by event type and a quote around the price."""
    volume = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        volume.alias("volume"),
        "event_type",
        F.when(F.col("event_type").isin("purchase", "click"), F.lit("bid"))
        .when(F.col("event_type").isin("view", "signup"), F.lit("ask"))
        .alias("side"),
        (F.col("value") - (volume + 1) / 1000).alias("bid"),
        (F.col("value") + (volume + 1) / 1000).alias("ask"),
        (volume + F.lit(1.0)).alias("bid_volume"),
        (F.lit(100.0) - volume).alias("ask_volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: F lines are buys (bid), O lines sells (ask)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.when(F.col("l_linestatus") == "F", F.lit("bid")).otherwise(F.lit("ask")).alias("side"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("supplier"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderpriority").alias("priority"),
    )


BOOK_TIE = ("order_id", "line_no", "volume", "discount", "tax", "flag", "part")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a supplier and month as the levels of one book: F bids, O asks 1000 higher."""
    bid = F.col("l_linestatus") == "F"
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.when(bid, F.lit("bid")).otherwise(F.lit("ask")).alias("side"),
        F.when(bid, price).otherwise(price + 1000).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part"),
    )
