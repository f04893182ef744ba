"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition reduces its texts to a run of digests.  In each round
``fan_in`` neighbouring runs meet and are merged by digest; each level keeps,
per digest, the row that stays and the number of rows seen, so a large group of
copies shrinks to one entry per run before it is ever shuffled.  The runs of a
round are spread by digest, hence no task holds a whole level.  The answers go
down the same tree: root to runs by digest, runs to rows by (run, digest), so a
digest shared by a third of all rows is never one join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BLANKS, table, texts

FAN_IN = 16
# Equality of texts is accepted only if all three agree.
KEY = ["digest", "witness", "length"]


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its run, digest and what decides which copy stays."""
    plain = texts(docs).select("doc_id", F.length("text").alias("n_chars"), F.translate("text", BLANKS, "").alias("plain"))
    return plain.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("plain", 256).alias("digest"),
        F.xxhash64("plain").alias("witness"), F.length("plain").alias("length"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
    )


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(runs of the lowest level, root): per digest the first row and the count."""
    first = F.struct(
        (-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("keep_id"),
        F.col("row").alias("keep_row"),
    )
    lowest = rows.groupBy("run", *KEY).agg(F.min(first).alias("first"), F.count("*").alias("n"))
    last_run = rows.agg(F.max("run")).first()[0] or 0
    level, runs = lowest, last_run + 1
    while runs > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        )
        runs = -(-runs // fan_in)
    return lowest, level.drop("run")


def resolve(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document with the copy that stays.

    Texts are equal if identical without ``[\\x20\\x09-\\x0D]``; of equal ones the
    row with the most code points stays, then the smallest doc_id (null last).
    Null text is empty text, and all empty texts are copies of each other.  Of
    rows that agree in text and doc_id exactly one stays.  An empty table gives
    an empty result; other columns of ``docs`` are not read.
    """
    rows = table(digests(docs), "digests")
    lowest, root = merge_runs(rows, fan_in)
    root = root.select(*KEY, F.col("first.keep_id").alias("keep_id"), F.col("first.keep_row").alias("keep_row"), F.col("n").alias("group_size"))
    down = lowest.select("run", *KEY).join(root, KEY)
    return rows.join(down, ["run", *KEY]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"), "n_chars",
    )


def kept_documents(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts the one with the most code points stays, then the smallest
    doc_id, null last; of rows that agree in doc_id and text one.  Null text equals
    empty text and text of white space alone; texts of any length are compared
    whole; an empty table gives an empty result.
    """
    fate = table(resolve(docs, fan_in), "fate")
    plain = F.translate(F.coalesce(docs["text"], F.lit("")), BLANKS, "")
    keys = fate.groupBy(F.col("doc_id").alias("__d"), F.col("n_chars").alias("__n"), F.col("text_sha256").alias("__t")).agg(
        F.max("kept").alias("__kept"), F.count("*").alias("__rows")
    )
    gone = keys.where(~F.col("__kept"))
    length = F.length(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(gone["__d"]) & (length == gone["__n"]) & (F.sha2(plain, 256) == gone["__t"])
    stay = docs.join(gone, same, "left_anti")
    # Rows that agree in doc_id, length and text: only where there are any.
    repeated = keys.where(F.col("__kept") & (F.col("__rows") > 1)).drop("__kept", "__rows")
    if repeated.isEmpty():
        return stay
    packed = stay.select(F.struct("*").alias("r"))
    text = F.coalesce(F.col("r.text"), F.lit(""))
    packed = packed.withColumns({"__a": F.col("r.doc_id"), "__b": F.length(text), "__c": F.sha2(F.translate(text, BLANKS, ""), 256)})
    match = F.col("__a").eqNullSafe(F.col("__d")) & (F.col("__b") == F.col("__n")) & (F.col("__c") == F.col("__t"))
    one = packed.join(repeated, match, "left_semi").groupBy("__a", "__b", "__c").agg(F.min_by("r", F.struct(F.col("r.text").isNull(), F.coalesce("r.text", F.lit("")))).alias("r"))
    return packed.join(repeated, match, "left_anti").select("r.*").unionByName(one.select("r.*"))
