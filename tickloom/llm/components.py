"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import table


def _lowest(edges: DataFrame) -> DataFrame:
    """Per node the lowest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node of an edge with the lowest node it can reach.

    Nodes without an edge are not listed; self loops and repeated edges do no
    harm; an empty table gives an empty one.  Both stars shuffle by node with
    minima combined before the shuffle; a node with very many edges is a skewed
    join side, which adaptive execution splits.
    """
    current = table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        current = table(_small_star(table(_large_star(current), "large")), "small")
        state = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = state
