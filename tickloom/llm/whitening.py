"""Whitening of embeddings along the leading eigenvectors of their covariance, by Jacobi-Davidson.

The covariance is never formed: a product with a block of vectors is one pass
over the distinct vectors, centred before multiplying, summed by Spark.  The
driver holds a search space of some tens of vectors as long as one embedding.
Correction equations, projected off the locked and the current eigenvectors, are
solved by a few steps of MINRES, all of a round in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import table

COMPONENTS = 4
BLOCK_BYTES = 4 << 20
# Residual norm, as a multiple of the largest eigenvalue and the machine's precision, at which a vector is locked.
PRECISION = 64
INNER_STEPS = 4
SPACE = 24
ROUNDS = 200
_KINDS = ("<i2", "<i4", "<i8")
Product = Callable[[np.ndarray], np.ndarray]


def _packed(x: np.ndarray) -> bytes:
    """A vector in the smallest of the integer kinds that holds it, so that equal vectors have equal bytes."""
    low, high = int(x.min()), int(x.max())
    for i, kind in enumerate(_KINDS):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            break
    return bytes([i]) + x.astype(kind).tobytes()


def _unpacked(vectors: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(v, dtype=_KINDS[v[0]], offset=1) for v in vectors], dtype=np.int64)


def _grid(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that have a vector, floor(256 * entry) of each) of a list column; other rows are null or hold null or non-finite entries."""
    rows, found = [], []
    for i, v in enumerate(column):
        if not v.is_valid or not len(v) or v.values.null_count:
            continue
        values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(values).all():
            rows.append(i)
            found.append(np.clip(np.floor(256 * values), -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    return np.array(rows, dtype=np.int64), found


def _usual_length(vectors: DataFrame) -> int | None:
    row = vectors.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    return row["length"] if row else None


def fit_list(embeddings: DataFrame) -> tuple[DataFrame, int | None]:
    """Each distinct vector once, as a written table (vector binary), and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _grid(batch.column("embedding"))
            yield pa.RecordBatch.from_pydict({"length": pa.array([len(v) for v in found], pa.int32()), "vector": pa.array(list(map(_packed, found)), pa.binary())})

    distinct = table(embeddings.select("embedding").mapInArrow(run, "length int, vector binary").distinct(), "vectors")
    length = _usual_length(distinct)
    return distinct.where(F.col("length") == F.lit(length)).select("vector"), length


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    rows = max(1, BLOCK_BYTES // (8 * length))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield _unpacked(batch.column("vector").slice(a, rows).to_pylist())


def _summed(vectors: DataFrame, length: int, kind: str, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``part(block)``, which has ``size`` numbers; Spark adds the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches, length):
            own = part(block)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(size), pa.int32()), "value": pa.array(total.ravel())})

    rows = vectors.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    for row in rows:
        out[row["place"]] = row["value"]
    return out


def centred_product(vectors: DataFrame, length: int, n: int, mean: np.ndarray) -> Product:
    """Product of the covariance (divisor ``n``) with the columns of a matrix, in one pass."""

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ block)

        return _summed(vectors, length, "double", block.size, part).reshape(block.shape) / n

    return product


def _minres(apply: Product, rhs: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for several symmetric systems at once, one column each; ``apply`` multiplies column j by system j."""
    x, norm = np.zeros_like(rhs), np.linalg.norm(rhs, axis=0)
    beta, live = norm.copy(), norm > 0
    v_old, v = np.zeros_like(rhs), np.divide(rhs, beta, out=np.zeros_like(rhs), where=live)
    d_old, d = np.zeros_like(rhs), np.zeros_like(rhs)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, prior = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        w = apply(v)
        alpha = (w * v).sum(axis=0)
        w -= alpha * v + prior * v_old
        after = np.linalg.norm(w, axis=0)
        # The new column of the tridiagonal matrix under the earlier two rotations and its own.
        far, near, diagonal = s_old * prior, c_old * c * prior + s * alpha, c * alpha - c_old * s * prior
        length = np.hypot(diagonal, after)
        live &= length > np.finfo(float).eps * norm
        safe = np.where(live, length, 1.0)
        c_old, s_old, c, s = c, s, np.where(live, diagonal / safe, 1.0), np.where(live, after / safe, 0.0)
        d_old, d = d, np.where(live, (v - near * d - far * d_old) / safe, 0.0)
        x += np.where(live, c * eta * d, 0.0)
        eta = -s * eta
        live &= (after > np.finfo(float).eps * np.abs(alpha)) & (np.abs(eta) > 1e-3 * norm)
        v_old, v = v, np.where(live, w / np.where(after > 0, after, 1.0), 0.0)
        prior = after
    return x


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``new`` that are orthogonal to ``against``; dependent ones go."""
    out = against
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - out @ (out.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10:
            column = column / left
            column = column - out @ (out.T @ column)
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, against.shape[1] :]


def leading(product: Product, length: int, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, falling; eigenvectors as columns; passes) of a symmetric product without negative eigenvalues."""
    passes = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(block)

    start = np.random.default_rng(seed).standard_normal((length, min(length, count + 2)))
    space = _orthonormal(times(_orthonormal(start, np.zeros((length, 0)))), np.zeros((length, 0)))
    # Fewer independent products than columns: the rest of the start, whose eigenvalue is 0, fills up.
    space = np.column_stack([space, _orthonormal(start, space)[:, : start.shape[1] - space.shape[1]]])
    image = times(space)
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        ritz, mapped = space @ turn[:, :count], image @ turn[:, :count]
        residual = mapped - ritz * values[:count]
        open_ = np.linalg.norm(residual, axis=0) > PRECISION * np.finfo(float).eps * max(values[0], 0.0)
        if not open_.any():
            return values[:count], ritz, passes
        # All Ritz vectors, locked (converged) ones too, are projected off.
        off = lambda y: y - ritz @ (ritz.T @ y)  # noqa: E731, B023
        shift = values[:count][open_]
        correction = _minres(lambda y: off(times(off(y)) - shift * off(y)), -off(residual[:, open_]), INNER_STEPS)  # noqa: B023
        if space.shape[1] + correction.shape[1] > min(SPACE, length):
            keep = turn[:, : min(length - correction.shape[1], count + 4)] if length > correction.shape[1] else turn[:, :count]
            space, image = space @ keep, image @ keep
        grown = _orthonormal(np.column_stack([correction, residual[:, open_]]), space)[:, : max(1, correction.shape[1])]
        if not grown.shape[1]:  # the whole space: only rounding is left
            space = _orthonormal(space, np.zeros((length, 0)))
            space = np.column_stack([space, _orthonormal(np.eye(length), space)])
            image = times(space)
            continue
        space, image = np.column_stack([space, grown]), np.column_stack([image, times(grown)])
    raise ArithmeticError(f"no convergence in {ROUNDS} rounds")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row with a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are
    dropped, and vectors of another length than the one that most distinct
    vectors have (of equal numbers: the longest).  Entries beyond 64 bits are
    cut at them.  Rows that repeat each get their rows, but each distinct vector
    counts once in the fit.  ``deviation`` is null where it does not fit 64 bits.
    Along a component without variance ``whitened`` is null and ``explained`` 0
    (null if no component has any).  An empty table gives an empty result; a null
    vec_id stays null; columns other than vec_id and embedding are not read.
    """
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors, length = fit_list(named)
    if length is None:
        return named.sparkSession.createDataFrame([], schema)
    n = vectors.count()
    sums = _summed(vectors, length, "long", length, lambda x: x.sum(axis=0))
    mean = sums / n
    total = float(_summed(vectors, length, "double", 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    values, axes, _ = leading(centred_product(vectors, length, n, mean), length, min(components, length))
    real = values > length * np.finfo(float).eps * max(total, 0.0)
    scale = np.where(real, np.sqrt(np.where(real, values, 1.0)), np.nan)
    seen = int(real.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ axes[:, :seen] / scale[:seen]
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    if seen:
        sums_of = _summed(vectors, length, "double", seen + seen * seen, moments) / n
        covariance = sums_of[seen:].reshape(seen, seen) - np.outer(sums_of[:seen], sums_of[:seen])
        error = float(np.abs(covariance - np.eye(seen)).max())
    else:
        error = None
    explained = [float(v / total) if ok else 0.0 if total > 0 else None for v, ok in zip(values, real)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            rows, found = _grid(batch.column("embedding"))
            same = [i for i, v in enumerate(found) if len(v) == length]
            if not same:
                continue
            x = np.array([found[i] for i in same])
            z = (x - mean) @ axes / scale
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows[same], k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), len(same)), pa.int32()), "n": pa.array([n] * (k * len(same)), pa.int64()),
                "deviation": pa.array([d for d in _deviations(x, n, sums) for _ in range(k)], pa.int64()),
                "whitened": pa.array(z.ravel(), pa.float64(), from_pandas=True),
                "explained": pa.array(explained * len(same), pa.float64()), "identity_error": pa.array([error] * (k * len(same)), pa.float64()),
            })

    return named.mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the entries of (n*x - sums)^2 of each row, exact; null beyond 64 bits."""
    reach = float(np.abs(x).max()) * n + float(np.abs(sums).max())
    if reach * reach * x.shape[1] < 2.0**62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [d if d < 2**63 else None for d in exact]
