"""Random forests grown level by level from counts that tasks make of packed rows.

Features become numbers of bins, one byte each, so a row costs a byte for each
feature and one for its class, written once.  A level is one job: tasks walk
their rows down the trees so far and count (node, feature, bin, class); the counts
of a tree are summed and its best splits found where they meet, and the driver
gets the splits.  No row is copied for a tree: how often a tree's sample holds
it is drawn again from its block's number.
"""

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stored

BINS, CLASSES = 32, 100
# Rows packed together, rows a task should have at least and counts a task holds at a time.
BLOCK, TASK_ROWS, COUNTS = 1 << 16, 1 << 14, 1 << 23
# A draw of 16 bits as a Poisson number of mean 1.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays (tree x node), children of node i at 2i + 1 and 2i + 2; what lies below a leaf repeats it."""

    features: tuple[str, ...]
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    shares: np.ndarray

    def classes(self, x: np.ndarray) -> np.ndarray:
        """The class of each row of a (row x feature) matrix with the largest sum of shares over the trees."""
        out = np.empty(len(x))
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            at, votes = np.arange(len(part)), np.zeros((len(part), self.shares.shape[2]))
            for feature, threshold, shares in zip(self.feature, self.threshold, self.shares):
                node = np.zeros(len(part), dtype=np.intp)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (part[at, feature[node]] > threshold[node])
                votes += shares[node]
            out[a : a + BLOCK] = votes.argmax(axis=1)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; its features must not be null."""

        @F.pandas_udf("double")
        def prediction(x: pd.DataFrame) -> pd.Series:
            return pd.Series(self.classes(x.to_numpy(dtype=float)))

        return df.withColumn("prediction", prediction(F.struct(*[F.col(c).cast("double") for c in self.features])))


def _packed(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The rows as blocks: a number, and bytes of their bins (feature after feature) and classes."""
    p = len(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            codes = [np.searchsorted(e, t.column(i).to_numpy()).astype(np.uint8).tobytes() for i, e in enumerate(edges)]
            return pa.RecordBatch.from_pydict({"block": [number], "codes": [b"".join(codes)], "labels": [t.column(p).to_numpy().astype(np.uint8).tobytes()]})

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= BLOCK:
                yield block()
                held, n, number = [], 0, number + 1
        if n:
            yield block()

    return stored(rows.mapInArrow(pack, "block long, codes binary, labels binary"))


def _chosen(seed: int, tree: int, level: int, p: int, most: int) -> np.ndarray:
    """(node of the level x feature) the features that may split each node."""
    rng = np.random.default_rng([seed, tree, level])
    return np.argsort(rng.random((1 << level, p)), axis=1)[:, :most]


def _counted(codes: np.ndarray, labels: np.ndarray, block: int, tree: int, level: int, feature: np.ndarray, cut: np.ndarray, chosen: np.ndarray, seed: int, classes: int) -> np.ndarray:
    """Counts (node of the level, chosen feature, bin, class) of a block in one tree."""
    drawn = np.frombuffer(np.random.default_rng([seed, tree, block >> 32, block & 0xFFFFFFFF]).bytes(2 * len(labels)), dtype="<u2")
    times = _POISSON[drawn]
    some = np.flatnonzero(times)
    mine, n = np.ascontiguousarray(codes[:, some]).ravel(), len(some)
    at, node = np.arange(n), np.zeros(n, dtype=np.intp)
    start = feature.astype(np.intp) * n
    for _ in range(level):
        node = 2 * node + 1 + (mine[start[node] + at] > cut[node])
    node -= (1 << level) - 1
    most, own, weight = chosen.shape[1], labels[some], times[some].astype(float)
    out = np.empty((1 << level, most, BINS, classes))
    first = node * (BINS * classes) + own
    for k in range(most):
        found = np.bincount(first + mine[(chosen[:, k] * n)[node] + at].astype(np.intp) * classes, weights=weight, minlength=(1 << level) * BINS * classes)
        out[:, k] = found.reshape(1 << level, BINS, classes)
    return out


def _best(counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, bin, counts to its left, to its right) of the split of each node with the largest gain in Gini impurity."""
    left = np.cumsum(counts, axis=2)[:, :, :-1]
    whole = counts[:, :1].sum(axis=2, keepdims=True)
    right = whole - left
    a, b, n = left.sum(axis=3), right.sum(axis=3), whole.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Impurity times rows is rows less this: the larger the sum of both sides, the better.
        held = (left**2).sum(axis=3) / a + (right**2).sum(axis=3) / b
        gain = np.where((a > 0) & (b > 0), held - (whole**2).sum(axis=3) / n, -1.0)
    flat = gain.reshape(len(counts), -1)
    best = flat.argmax(axis=1)
    nodes = np.arange(len(counts))
    which, cut = best // left.shape[2], best % left.shape[2]
    splits = flat[nodes, best] > 1e-9 * np.maximum(1.0, n[:, 0, 0])
    return np.where(splits, chosen[nodes, which], -1), cut, left[nodes, which, cut], right[nodes, which, cut]


def grown(train: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int) -> Forest:
    """A forest on rows without nulls: Gini impurity, 32 bins a feature by quantiles, Poisson samples, for each node the root of the number of features."""
    p = len(features)
    rows = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    probs = [k / BINS for k in range(1, BINS)]
    facts = rows.agg(
        F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.count_if(F.col("y") != F.floor("y")).alias("broken"),
        *[F.percentile_approx(f"x{i}", probs, 10_000).alias(f"e{i}") for i in range(p)],
    ).first()
    if not facts["n"]:
        raise ValueError("no rows to fit")
    if facts["low"] < 0 or facts["high"] >= CLASSES or facts["broken"]:
        raise ValueError(f"classes are whole numbers from 0 to {CLASSES - 1}")
    classes = int(facts["high"]) + 1
    edges = [np.unique(facts[f"e{i}"]) for i in range(p)]
    tasks = min(4 * rows.sparkSession.sparkContext.defaultParallelism, max(1, facts["n"] // TASK_ROWS))
    blocks = _packed(rows.repartition(tasks), edges)
    most = p if trees == 1 else math.ceil(math.sqrt(p))
    size = (2 << depth) - 1
    feature, cut = np.zeros((trees, size), dtype=np.int32), np.full((trees, size), 255, dtype=np.uint8)
    counts = np.zeros((trees, size, classes))
    for level in range(max(1, depth)):
        width = 1 << level
        together = max(1, COUNTS // (width * most * BINS * classes))
        for first in range(0, trees, together):
            some = range(first, min(trees, first + together))
            for r in _level(blocks, some, level, feature, cut, p, most, classes, seed).collect():
                t = r["tree"]
                found, where, left, right = (np.frombuffer(r[c], dtype=kind) for c, kind in (("feature", "<i4"), ("cut", "u1"), ("left", "<f8"), ("right", "<f8")))
                at = np.arange(width) + width - 1
                sides = left.reshape(width, classes), right.reshape(width, classes)
                if not level:
                    counts[t, 0] = sides[0] + sides[1]
                if depth:
                    splits = found >= 0
                    feature[t, at], cut[t, at] = np.where(splits, found, 0), np.where(splits, where, 255)
                    for child, side in ((2 * at + 1, sides[0]), (2 * at + 2, sides[1])):
                        counts[t, child] = np.where(splits[:, None], side, counts[t, at])
    total = counts.sum(axis=2, keepdims=True)
    shares = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    # Right of an edge lie the bins after its own; no value is above a leaf's.
    padded = np.array([np.concatenate([e, np.full(256 - len(e), np.inf)]) for e in edges])
    return Forest(tuple(features), depth, feature, padded[feature, cut], shares)


def _level(blocks: DataFrame, some: range, level: int, feature: np.ndarray, cut: np.ndarray, p: int, most: int, classes: int, seed: int) -> DataFrame:
    """Best splits of a level of some trees: (tree, feature, cut, left, right) as bytes."""
    upto = (1 << level) - 1
    known = {t: (feature[t, :upto].copy(), cut[t, :upto].copy()) for t in some}
    shape = (1 << level, most, BINS, classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {t: _chosen(seed, t, level, p, most) for t in some}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, codes, labels in zip(*(batch.column(c) for c in ("block", "codes", "labels"))):
                y = np.frombuffer(labels.as_buffer(), dtype=np.uint8)
                x = np.frombuffer(codes.as_buffer(), dtype=np.uint8).reshape(p, len(y))
                for t in some:
                    found = _counted(x, y, block.as_py(), t, level, *known[t], chosen[t], seed, classes)
                    total[t] = total[t] + found if t in total else found
        for t, found in total.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "counts": [found.astype("<i8").tobytes()]})

    def best(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, total = key[0].as_py(), np.zeros(shape, dtype=np.int64)
        for batch in batches:
            for part in batch.column("counts"):
                total += np.frombuffer(part.as_buffer(), dtype="<i8").reshape(shape)
        found, where, left, right = _best(total.astype(float), _chosen(seed, t, level, p, most))
        yield pa.RecordBatch.from_pydict({
            "tree": pa.array([t], pa.int32()), "feature": [found.astype("<i4").tobytes()], "cut": [where.astype("u1").tobytes()], "left": [left.astype("<f8").tobytes()], "right": [right.astype("<f8").tobytes()],
        })

    parts = blocks.mapInArrow(count, "tree int, counts binary")
    return parts.groupBy("tree").applyInArrow(best, "tree int, feature binary, cut binary, left binary, right binary")
