"""What the corpus operators share: input columns, durable tables, scratch folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_root

# Characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
# All characters but ASCII ones that are neither letter nor digit; of lower-cased text.
ALNUM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only ``doc_id``, ``text`` (null: empty) and ``more``: other columns cannot clash with those made later."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str, codec: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: Sequence[str]) -> Column:
    """Equality of ``keys`` and ``renamed``, nulls equal."""
    out = F.lit(True)
    for a, b in zip(keys, renamed):
        out = out & left[a].eqNullSafe(right[b])
    return out
