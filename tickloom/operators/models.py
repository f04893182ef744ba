"""Scaling, splits, model fitting, ensembles, anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalars import ratio
from tickloom.plans.forest import Forest, grown
from tickloom.plans.gram import column_moments, distance
from tickloom.plans.series import broadcast_if_small, numbered, placed, quantiles, running, unplaced, windowed
from tickloom.plans.shuffling import permuted_place
from tickloom.session import durable, stored

# Rows that a task of a fit holds in memory at most, and those for which a further task is worth starting.
ROWS_HELD, ROWS_DEALT = 1 << 18, 1 << 14


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def _one_row(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value): one row for each value of the columns."""
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(values).alias("v")).select("v.*")


def _long_quantiles(values: DataFrame, probs: Mapping[str, float], rows_per_task: int | None) -> DataFrame:
    """Quantiles of each name, all names in one pass; a row for each column."""
    return quantiles(values, "value", probs, keys=("name",), rows_per_task=rows_per_task)


def _wide(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``<c>_center`` and ``<c>_scale``; nulls for a column without values."""
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col(x))).alias(f"{c}_{x}") for c in columns for x in ("center", "scale")])


def fit_scaling(df: DataFrame, columns: Sequence[str], method: str = "zscore", rows_per_task: int | None = None) -> DataFrame:
    """Centre and scale per column as one row (``<c>_center``, ``<c>_scale``): zscore, minmax, mad or iqr."""
    if method == "zscore":
        return df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_center"), F.stddev_samp(c).alias(f"{c}_scale"))])
    if method == "minmax":
        return df.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}_center"), (F.max(c) - F.min(c)).alias(f"{c}_scale"))])
    if method == "iqr":
        q = _long_quantiles(_long(df, columns), {"m": 0.5, "lo": 0.25, "hi": 0.75}, rows_per_task)
        return _wide(q.select("name", F.col("m").alias("center"), (F.col("hi") - F.col("lo")).alias("scale")), columns)
    if method == "mad":
        values = _long(df, columns)
        middle = _long_quantiles(values, {"center": 0.5}, rows_per_task)
        off = values.join(F.broadcast(middle), "name").select("name", F.abs(F.col("value") - F.col("center")).alias("value"))
        return _wide(middle.join(_long_quantiles(off, {"scale": 0.5}, rows_per_task), "name"), columns)
    raise ValueError(f"unknown method {method}")


def apply_scaling(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - centre) / scale with the fitted row; a constant column gives null."""
    out = df.crossJoin(F.broadcast(fitted)).withColumns(
        {c: ratio(F.col(c) - F.col(f"{c}_center"), f"{c}_scale") for c in columns}
    )
    return out.drop(*[f"{c}_{x}" for c in columns for x in ("center", "scale")])


def normalise_features(df: DataFrame, method: str = "zscore", exclude: Sequence[str] = (), **how) -> DataFrame:
    cols = numeric_columns(df, exclude)
    return apply_scaling(df, fit_scaling(df, cols, method, **how), cols)


def _with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], **how) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = numbered(df, "_pos", keys=keys, order=order, **how).withColumn("_pos", F.col("_pos") - 1)
    return placed.join(broadcast_if_small(sizes), list(keys))


def time_series_split(df: DataFrame, folds: int = 3, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """Rows tagged (fold, part) for expanding training sets; the part after a fold's test is left out."""
    d = _with_position(df, keys, order, **how)
    size = F.floor(F.col("_n") / (folds + 1))
    each = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.col("_n") - (folds - F.col("fold")) * size
    part = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + size, "test")
    return each.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_pos", "_n")


def walk_forward(df: DataFrame, train: int = 252, test: int = 63, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """Rows tagged (period, part) for rolling windows; a row belongs to at most train / test + 2 periods."""
    d = _with_position(df, keys, order, **how)
    p = F.col("_pos")
    first = F.greatest(F.lit(0), F.ceil((p - (train + test - 1)) / test))
    last = F.least(F.floor(p / test), F.floor((F.col("_n") - train - test) / test))
    spans = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    each = d.withColumn("period", F.explode(spans))
    part = F.when(p < F.col("period") * test + train, "train").otherwise("test")
    return each.withColumn("part", part).drop("_pos", "_n")


def period_summary(tagged: DataFrame, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per period: mean of the value in training and test rows."""
    def mean(part: str) -> Column:
        return F.avg(F.when(F.col("part") == part, F.col(value)))

    return tagged.groupBy(*keys, "period").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows"),
        mean("train").alias("train_mean"), mean("test").alias("test_mean"),
    )


def _with_label(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is a finite number; without one a row can be neither fitted nor scored."""
    return df.filter(F.abs(F.col(label).cast("double")) < F.lit(float("inf")))


def _known(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows in which no feature is null or NaN, as ``_assembled`` keeps them."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features]))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)


def fit_direction(train: DataFrame, features: Sequence[str], label: str = "direction", trees: int = 100, depth: int = 10, seed: int = 42) -> Forest:
    """A random forest of classes 0, 1, ...; rows with a null or NaN feature are left out."""
    return grown(_known(_with_label(train, label), features), features, label, trees, depth, seed)


def fit_magnitude(train: DataFrame, features: Sequence[str], label: str = "magnitude", rounds: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42):
    from pyspark.ml.regression import GBTRegressor

    rows = _assembled(_with_label(train, label), features).select("_x", label)
    # A round is several short jobs: few tasks for few rows, and no more rows in a task than it can hold.
    n, cores = rows.count(), train.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(max(-(-n // ROWS_HELD), min(cores, n // ROWS_DEALT), 1))
    return GBTRegressor(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(rows)


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    if isinstance(model, Forest):
        return model.transform(_known(df, features))
    return model.transform(_assembled(df, features)).drop("_x", "rawPrediction", "probability")


def fold_scores(tagged: DataFrame, fit, features: Sequence[str], label: str, classify: bool, folds: int = 3) -> DataFrame:
    """Accuracy or mean squared error per fold; the loop is over a handful of model fits.

    A fit reads its rows several times: what it needs of them is written once.
    """
    held = stored(_with_label(tagged.select("fold", "part", *features, label), label))
    out = None
    for k in range(folds):
        fold = held.filter(F.col("fold") == k)
        model = fit(fold.filter("part = 'train'"), features)
        seen = predict(model, fold.filter("part = 'test'"), features)
        right = (F.col("prediction") == F.col(label)).cast("double")
        score = F.avg(right) if classify else F.avg(F.pow(F.col("prediction") - F.col(label), 2))
        row = seen.agg(F.lit(k).alias("fold"), F.count("*").alias("rows"), score.alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", keys: Sequence[str] = ()) -> DataFrame:
    a, b = F.col(y), F.col(yhat)
    e = a - b
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"),
        F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("direction_accuracy"),
    )


def sequence_windows(df: DataFrame, features: Sequence[str], n: int, target: str, share: float = 0.8, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """The ``n`` feature vectors before each row, oldest first, with an ordered train/test tag."""
    vec = F.array(*[F.col(c).cast("double") for c in features])

    def add(d, w):
        before = w.rowsBetween(-n, -1)
        return d.withColumn("window", F.when(F.count("*").over(before) == n, F.collect_list(vec).over(before)))

    d = windowed(df, add, keys=keys, order=order, back=n, **how).filter(F.col("window").isNotNull())
    d = _with_position(d, keys, order, **how)
    part = F.when(F.col("_pos") < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")
    return d.withColumn("part", part).withColumn("target", F.col(target)).drop("_pos", "_n")


def ensemble_combine(predictions: DataFrame, weights: DataFrame | None = None, row: Sequence[str] = ("row_id",)) -> DataFrame:
    """Mean, and weighted mean if weights (model, weight) are given, of long predictions (row, model, yhat)."""
    plain = F.avg("yhat").alias("mean")
    if weights is None:
        return predictions.groupBy(*row).agg(plain)
    w = predictions.join(broadcast_if_small(weights), "model")
    return w.groupBy(*row).agg(plain, ratio(F.sum(F.col("yhat") * F.col("weight")), F.sum("weight")).alias("weighted"))


def ensemble_weights(errors: DataFrame, floor: float = 0.01) -> DataFrame:
    """Inverse mean absolute error per model, floored and renormalised (a row per model)."""
    inv = errors.groupBy("model").agg((1 / (F.avg(F.abs("error")) + 1e-8)).alias("_inv"))
    total = inv.agg(F.sum("_inv").alias("_t"))
    share = inv.crossJoin(F.broadcast(total)).select("model", F.greatest(F.col("_inv") / F.col("_t"), F.lit(floor)).alias("_w"))
    again = share.agg(F.sum("_w").alias("_t"))
    return share.crossJoin(F.broadcast(again)).select("model", (F.col("_w") / F.col("_t")).alias("weight"))


def ensemble_stacking(predictions: DataFrame, targets: DataFrame, models: Sequence[str], row: str = "row_id", y: str = "y") -> DataFrame:
    """Least squares of y on the base predictions: the coefficients as rows (name, coefficient)."""
    from pyspark.ml.regression import LinearRegression

    wide = predictions.groupBy(row).pivot("model", list(models)).agg(F.first("yhat")).join(targets, row)
    fit = LinearRegression(featuresCol="_x", labelCol=y, solver="normal", standardization=False).fit(_assembled(wide, models))
    rows = [*zip(models, map(float, fit.coefficients)), ("intercept", float(fit.intercept))]
    return predictions.sparkSession.createDataFrame(rows, "name string, coefficient double")


def importance_by_category(contributions: DataFrame, categories: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, summed per category."""
    each = contributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    return each.join(broadcast_if_small(categories), "feature").groupBy("category").agg(F.sum("importance").alias("importance"), F.count("*").alias("features"))


def permuted(df: DataFrame, columns: Sequence[str], seed: int = 42, row: str = "row_id", rows_per_task: int | None = None) -> DataFrame:
    """``df`` once for each of ``columns`` (column ``feature``), with that column shuffled, and once as it is (``feature`` null).

    Row numbers follow ``row``, which must tell rows apart.  A keyed one-to-one
    map of the row numbers says which row gets whose value, so all shuffles are
    one equi-join of the numbered rows with themselves.
    """
    placed_rows = numbered(df, "_i", keys=(), order=(row,), rows_per_task=rows_per_task).withColumn("_i", F.col("_i") - 1)
    size = df.agg(F.count("*").alias("_n"))
    sent = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), permuted_place(F.col("_i"), F.col("_n"), F.lit(seed + k)).alias("_to"), F.col(c).cast("double").alias("_v"))
            for k, c in enumerate(columns)
        ],
        F.struct(F.lit(None).cast("string").alias("feature"), F.col("_i").alias("_to"), F.lit(None).cast("double").alias("_v")),
    )
    values = placed_rows.crossJoin(F.broadcast(size)).select(F.explode(sent).alias("s")).select("s.*")
    both = placed_rows.join(values, F.col("_i") == F.col("_to"))
    swapped = {c: F.when(F.col("feature") == c, F.col("_v")).otherwise(F.col(c).cast("double")) for c in columns}
    return both.withColumns(swapped).drop("_i", "_to", "_v")


def permutation_importance(df: DataFrame, features: Sequence[str], score: Column, **how) -> DataFrame:
    """Change of an aggregate ``score`` when a feature is shuffled: feature, importance; one grouped score for all features."""
    scored = permuted(df, features, **how).groupBy("feature").agg(score.alias("score"))
    base = scored.where("feature IS NULL").select(F.col("score").alias("base"))
    return scored.where("feature IS NOT NULL").crossJoin(F.broadcast(base)).select("feature", (F.col("score") - F.col("base")).alias("importance"))


def _flagged(scored: DataFrame, contamination: float, rows_per_task: int | None) -> DataFrame:
    cut = quantiles(scored, "distance", {"_cut": 1 - contamination}, keys=(), rows_per_task=rows_per_task)
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("distance") > F.col("_cut")).drop("_cut")


def anomaly_distance(df: DataFrame, columns: Sequence[str], contamination: float = 0.1, rows_per_task: int | None = None) -> DataFrame:
    """Squared Mahalanobis distance and a flag on its largest share.

    Means and covariances come from one pass of matrix products; the driver
    inverts the (columns x columns) matrix only.  Rows with a null have no distance.
    """
    _, mean, covariance = column_moments(df, columns)
    scored = df.withColumn("distance", distance(columns, mean, np.linalg.pinv(covariance, hermitian=True)))
    return _flagged(scored, contamination, rows_per_task)


def robust_distance(
    df: DataFrame, columns: Sequence[str], contamination: float = 0.1, support: float = 0.5, steps: int = 20, rows_per_task: int | None = None
) -> DataFrame:
    """Squared distance by a robust mean and covariance, and a flag on its largest share.

    The start is the distance from the medians in units of the median deviation.
    Each step takes the share ``support`` of the rows that are nearest, their mean
    and covariance, and the distances by these; the determinant falls until the
    rows no longer change.  Distances are scaled so that their median is that of
    a normal sample.  Outliers that would widen a plain covariance and so hide in
    it are far from this one.  Rows with a null have no distance.
    """
    p = len(columns)
    # Read several times a step: the numbers alone, once.
    whole = durable(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    centre, scale = _medians(whole, columns, rows_per_task)
    if centre is None:
        return df.withColumns({"distance": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("boolean")})
    mean, inverse, last = centre, np.diag(1 / scale**2), np.inf
    for _ in range(steps):
        near = whole.withColumn("_d", distance(columns, mean, inverse))
        cut = quantiles(near, "_d", {"_cut": support}, keys=(), rows_per_task=rows_per_task).first()["_cut"]
        _, mean, covariance = column_moments(near.where(F.col("_d") <= F.lit(cut)), columns, mean)
        inverse = np.linalg.pinv(covariance, hermitian=True)
        sign, size = np.linalg.slogdet(covariance)
        now = size if sign > 0 else -np.inf
        if not now < last - 1e-9 * max(1.0, abs(now)):
            break
        last = now
    scored = df.withColumn("distance", distance(columns, mean, inverse))
    middle = quantiles(scored, "distance", {"_m": 0.5}, keys=(), rows_per_task=rows_per_task).first()["_m"]
    # The median of a chi-square variable (Wilson and Hilferty).
    normal = p * (1 - 2 / (9 * p)) ** 3
    return _flagged(scored.withColumn("distance", F.col("distance") * F.lit(normal / middle if middle else 1.0)), contamination, rows_per_task)


def _medians(df: DataFrame, columns: Sequence[str], rows_per_task: int | None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(medians, median deviations, 1 where they are 0) of the columns, all in one grouped quantile each."""
    found = fit_scaling(df, columns, "mad", rows_per_task).first()
    centre = np.array([np.nan if found is None or found[f"{c}_center"] is None else found[f"{c}_center"] for c in columns])
    if np.isnan(centre).any():
        return None, None
    scale = np.array([found[f"{c}_scale"] or 1.0 for c in columns])
    return centre, 1.4826 * scale


def regime_change(df: DataFrame, score: str, n: int = 10, factor: float = 2.0, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq"), **how) -> DataFrame:
    """Whether the mean of the last ``n`` scores is above ``factor`` times the mean of all before them."""
    totals = running(placed(df, keys=keys, order=order, **how), {"_sum": ("sum", F.col(score)), "_count": ("count", F.lit(1))}, keys=keys, order=order, **how)

    def add(d, w):
        recent = w.rowsBetween(-(n - 1), 0)
        return d.withColumns({"recent_mean": F.avg(score).over(recent), "_s": F.lag("_sum", n).over(w), "_c": F.lag("_count", n).over(w)})

    out = windowed(totals, add, keys=keys, order=order, back=n, **how).withColumn("earlier_mean", F.try_divide("_s", "_c"))
    flag = F.coalesce(F.col("recent_mean") > F.lit(factor) * F.col("earlier_mean"), F.lit(False))
    return unplaced(out).withColumn("regime_change", flag).drop("_sum", "_count", "_s", "_c")


def l2_normalise(df: DataFrame, vector: str) -> DataFrame:
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return df.withColumn("_norm", norm).withColumn(
        vector, F.transform(F.col(vector), lambda x: F.try_divide(x.cast("double"), F.col("_norm")))
    ).drop("_norm")


def category_map(spark, mapping: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "feature string, category string")
