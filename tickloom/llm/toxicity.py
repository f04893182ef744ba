"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other, from the severest to plain
"toxic"; each model sees the probabilities of those before it.  In training these
are out-of-fold predictions, so a later model learns how far an earlier one can be
trusted on documents it has not seen.  Features are words and word beginnings,
chosen by how differently toxic and clean labelled documents hold them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import texts
from tickloom.llm.words import slices

# Bounds of what is fitted: labelled documents taken of each class, features kept.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
FEATURES = 4_000
LEAST_DOCUMENTS = 4
FOLDS = 3
LEAST_STRENGTH = 4.0
PENALTY = 0.2
THRESHOLD = 0.5
# Category: distinct marker words a toxic document has at least. The last is the label itself.
CATEGORIES = (("heavy", 6), ("repeated", 3), ("toxic", 0))
PREFIXES = (4, 5)
CACHE_WORDS = 500_000
SEED = 23
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a trailing ``*``)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """Weights of each category's model over the features, then its intercept and weights of earlier probabilities."""

    features: dict[str, int]
    names: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    earlier: np.ndarray
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def rows(self, column: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids, row starts) of texts."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known, ids, starts = self.cache, [], [0]
        for text in column:
            own: set[int] = set()
            for word in words_of(text):
                hit = known.get(word)
                if hit is None:
                    hit = known[word] = tuple(i for f in features_of(word) if (i := self.features.get(f)) is not None)
                own.update(hit)
            ids += sorted(own)
            starts.append(len(ids))
        return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)

    def predict(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities (rows x categories)."""
        out = np.zeros((len(starts) - 1, len(self.names)))
        for k in range(len(self.names)):
            out[:, k] = sigmoid(dot(ids, starts, self.weights[k]) + self.intercepts[k] + out[:, :k] @ self.earlier[k, :k])
        return out

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def dot(ids: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[ids])]) if len(ids) else np.zeros(1)
    return sums[starts[1:]] - sums[starts[:-1]]


def fit_linear(ids, starts, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int, penalty: float = PENALTY, rounds: int = 60):
    """Logistic regression with squared penalty by L-BFGS: (weights, intercept, weights of ``extra``)."""
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    k = extra.shape[1]
    ridge = np.concatenate([np.full(n_features, penalty), [1e-6], np.full(k, penalty / 10)])

    def value(w):
        z = dot(ids, starts, w[:n_features]) + w[n_features] + extra @ w[n_features + 1 :]
        p = sigmoid(z)
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * w * w).sum()
        g = weight * (p - y)
        grad = np.concatenate([np.bincount(ids, weights=g[row], minlength=n_features), [g.sum()], extra.T @ g])
        return loss, grad + ridge * w

    w = np.zeros(n_features + 1 + k)
    loss, grad = value(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d in reversed(steps):
            a = (s @ q) / (s @ d)
            alphas.append(a)
            q -= a * d
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1.0 / max(1.0, np.abs(grad).max())
        for (s, d), a in zip(steps, reversed(alphas)):
            q += s * (a - (d @ q) / (s @ d))
        rate, slope = 1.0, grad @ q
        while True:
            new, new_grad = value(w - rate * q)
            if new <= loss - 1e-4 * rate * slope or rate < 1e-6:
                break
            rate /= 2
        step, change = -rate * q, new_grad - grad
        w, done = w + step, abs(loss - new) <= 1e-7 * abs(loss)
        loss, grad = new, new_grad
        if step @ change > 1e-12:
            steps = [*steps[-7:], (step, change)]
        if done:
            break
    return w[:n_features], w[n_features], w[n_features + 1 :]


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, seed: int = SEED) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of a bounded, hash-ordered sample of labelled documents; how many are labelled 0 and 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(seed), "doc_id")
    some = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((1, toxic), (0, clean))]
    # At most toxic + clean rows of 12 bytes.
    picked = F.broadcast(some[0].union(some[1]).withColumnRenamed("doc_id", "__id"))
    mine = texts(docs)
    return mine.join(picked, mine["doc_id"] == picked["__id"]).select("doc_id", "text", "toxic"), counts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, clean documents) of one partition."""
    held = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held[1 - toxic].update({f for w in words_of(text) for f in features_of(w)})
    names = list(held[0].keys() | held[1].keys())
    yield pa.RecordBatch.from_pydict({
        "feature": pa.array(names, pa.string()), "toxic": pa.array([held[0][f] for f in names], pa.int64()),
        "clean": pa.array([held[1][f] for f in names], pa.int64()),
    })


def choose_features(mine: DataFrame, n: int = FEATURES, least: int = LEAST_DOCUMENTS) -> tuple[dict[str, int], list[str]]:
    """Features by strength of association (deviations from chance), and those that mark toxic documents: 20 times as frequent there."""
    totals = {r["toxic"]: r["count"] for r in mine.groupBy("toxic").count().collect()}
    t, c = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))
    found = mine.select("text", "toxic").mapInArrow(_counts, "feature string, toxic long, clean long")
    found = found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= least)
    p, q = (F.col("toxic") + 0.5) / (t + 1), (F.col("clean") + 0.5) / (c + 1)
    both = (F.col("toxic") + F.col("clean") + 0.5) / (t + c + 1)
    strength = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / t + 1 / c))
    top = found.withColumns({"strength": strength, "ratio": p / q}).where(F.col("strength") >= LEAST_STRENGTH).orderBy(F.col("strength").desc(), "feature").limit(n).collect()
    return {r["feature"]: i for i, r in enumerate(top)}, [r["feature"] for r in top if r["ratio"] >= 20]


def train(docs: DataFrame, labels: DataFrame, threshold_sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN), folds: int = FOLDS, seed: int = SEED) -> Chain:
    """Fit the chain on a bounded sample; without both classes every probability is 0 (or 1 if all are toxic).

    Labels with a null doc_id or a null flag are left out, and so are documents
    without label; null text is empty; a doc_id that repeats counts as often as it
    occurs.  Empty tables give the chain without classes.  Of ``docs`` only doc_id
    and text are read, of ``labels`` doc_id and toxic.
    """
    mine, counts = sample(docs, labels, *threshold_sample, seed=seed)
    names = [name for name, _ in CATEGORIES]
    features, markers = choose_features(mine)
    empty = Chain(features, names, np.zeros((len(names), len(features))), np.zeros(len(names)), np.zeros((len(names), len(names))))
    marks = {features[m] for m in markers}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = empty.rows(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                "ids": pa.array([ids[a:b] for a, b in zip(starts[:-1], starts[1:])], pa.list_(pa.int64())),
            })

    # The sample is bounded by its two parameters, and each row by the number of features.
    rows = sorted(mine.mapInArrow(encode, "doc_id long, toxic int, ids array<long>").collect(), key=lambda r: (r["doc_id"], r["toxic"], r["ids"]))
    y = np.array([r["toxic"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        empty.intercepts[:] = 40.0 if len(y) and y.max() == 1 else -40.0
        return empty
    ids = np.array([i for r in rows for i in r["ids"]], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r["ids"]) for r in rows])])
    severity = np.array([len(marks.intersection(r["ids"])) for r in rows])
    fold = np.arange(len(y)) % folds
    # The classes are sampled at different rates; weights restore those of all labels.
    share = {t: counts.get(t, 0) / max(1, (y == t).sum()) for t in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight /= weight.mean()
    n, before = len(features), np.zeros((len(y), 0))
    for k, (_, least) in enumerate(CATEGORIES):
        target = y * (severity >= least)
        out_of_fold = np.zeros(len(y))
        for f in range(folds):
            own = fold != f
            w, b, v = fit_linear(*_subset(ids, starts, own), before[own], target[own], weight[own], n)
            out_of_fold[~own] = sigmoid(dot(*_subset(ids, starts, ~own), w) + b + before[~own] @ v)
        empty.weights[k], empty.intercepts[k], empty.earlier[k, :k] = fit_linear(ids, starts, before, target, weight, n)
        before = np.column_stack([before, out_of_fold])
    return empty


def _subset(ids: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(starts)
    return ids[np.repeat(own, sizes)], np.concatenate([[0], np.cumsum(sizes[own])])


def scored(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Per document the probability of each category and whether it counts as toxic.

    Null or empty text has no features.  Rows that repeat each get their row, a
    null doc_id stays null, an empty table gives an empty result; columns other
    than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = chain.predict(*chain.rows(batch.column("text").to_pylist()))
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {f"p_{name}": pa.array(p[:, k], pa.float64()) for k, name in enumerate(chain.names)}
            yield pa.RecordBatch.from_pydict(columns | {"toxic": pa.array(p[:, -1] >= threshold, pa.bool_())})

    schema = "doc_id long, " + ", ".join(f"p_{name} double" for name in chain.names) + ", toxic boolean"
    return texts(docs).mapInArrow(run, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that do not count as toxic, with all their columns, whatever their names.

    Null and empty text is scored as text without words; texts of any length are
    read whole.  Rows that repeat are judged alike; a null doc_id is judged by its
    text; nulls in other columns stay; an empty table gives an empty result.
    Without labelled rows of both classes all rows are judged as ``train`` says.
    """
    chain = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = chain.predict(*chain.rows(batch.column("text").to_pylist()))
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
