"""Models of the queries: whole parameters, and the forest against a plain program."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.operators import models
from tickloom.plans import forest


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, size=(600, 3)).astype(float)
    y = ((x[:, 0] > 9) ^ (x[:, 1] > 4)).astype(float) + (x[:, 2] > 17)
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double"), x, y


@pytest.mark.parametrize("name", ["fit_direction", "fit_magnitude"])
def test_queries_fit_whole_models(name, spark, sf, rows, monkeypatch):
    """100 trees of depth 10, and 100 rounds of depth 6 at a rate of 0.1, as the operators have them."""
    import pyspark.ml.regression as ml

    given = {}

    class Regressor:
        def __init__(self, **how):
            given.update(how)

        def fit(self, df):
            return None

    def only_fit(tagged, fit, *_, **__):
        df = rows[0].withColumnsRenamed({"y": "direction"}).withColumn("magnitude", F.col("direction"))
        given["model"] = fit(df, ["a", "b", "c"])
        return tagged.limit(0).select("fold")

    monkeypatch.setattr(ml, "GBTRegressor", Regressor)
    monkeypatch.setattr(models, "fold_scores", only_fit)
    entry.queries()[name](spark, sf)
    if name == "fit_direction":
        assert given["model"].feature.shape == (100, 2**11 - 1) and given["model"].depth == 10
    else:
        assert (given["maxIter"], given["maxDepth"], given["stepSize"]) == (100, 6, 0.1)


def test_forest_is_that_of_a_plain_program(rows, monkeypatch):
    """One tree on all its sample's rows, split by split, however rows lie in tasks and blocks."""
    df, x, y = rows
    model = models.fit_direction(df.coalesce(1), list("abc"), "y", trees=1, depth=4)
    draws = np.random.default_rng([42, 0, 0, 0]).bytes(2 * len(y))
    # Rows of one block: their order there is that of the packed table, so the sample is read off by value.
    blocks = forest._packed(df.select(F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("c").alias("x2"), F.col("y")).repartition(1), [np.arange(20.0)] * 3).collect()
    assert len(blocks) == 1 and blocks[0]["block"] == 0
    own = np.frombuffer(blocks[0]["codes"], np.uint8).reshape(3, -1).T.astype(float)
    label = np.frombuffer(blocks[0]["labels"], np.uint8).astype(int)
    times = forest._POISSON[np.frombuffer(draws, "<u2")]
    assert abs(times.mean() - 1) < 0.15 and sorted(map(tuple, own)) == sorted(map(tuple, x))

    def gini(some):
        n = np.bincount(label[some], weights=times[some], minlength=3)
        return n.sum() - (n**2).sum() / max(n.sum(), 1)

    def check(node, some, level):
        n = np.bincount(label[some], weights=times[some], minlength=3)
        assert np.allclose(model.shares[0, node], n / n.sum())
        if level == 4:
            return
        gains = {}
        for f in range(3):
            for t in np.unique(x[:, f])[:-1]:
                a, b = some[own[some, f] <= t], some[own[some, f] > t]
                if times[a].sum() and times[b].sum():
                    gains[f, t] = gini(some) - gini(a) - gini(b)
        f, t = model.feature[0, node], model.threshold[0, node]
        if max(gains.values(), default=0) < 1e-6:
            assert t == np.inf
            return
        assert gains[f, t] == pytest.approx(max(gains.values()))
        check(2 * node + 1, some[own[some, f] <= t], level + 1)
        check(2 * node + 2, some[own[some, f] > t], level + 1)

    check(0, np.arange(len(label)), 0)


def test_forest_predicts_in_blocks_and_groups_of_trees(spark, rows, monkeypatch):
    df, x, y = rows
    want = models.fit_direction(df, list("abc"), "y", trees=12, depth=5)
    assert (want.classes(x) == y).mean() > 0.9
    monkeypatch.setattr(forest, "COUNTS", 1 << 12)
    got = models.fit_direction(df, list("abc"), "y", trees=12, depth=5)
    assert (got.classes(x) == y).mean() > 0.9
    monkeypatch.setattr(forest, "BLOCK", 100)
    monkeypatch.setattr(forest, "TASK_ROWS", 50)
    many = models.fit_direction(df, list("abc"), "y", trees=12, depth=5)
    assert (many.classes(x) == y).mean() > 0.9
    odd = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)], df.schema))
    seen = models.predict(want, odd, list("abc")).collect()
    assert len(seen) == 600 and {r["prediction"] for r in seen} == {0.0, 1.0, 2.0}


def test_classes_are_whole_numbers(spark):
    for y in (0.5, -1.0, 100.0):
        with pytest.raises(ValueError, match="whole numbers"):
            models.fit_direction(spark.createDataFrame([(1.0, y), (2.0, 0.0)], "x double, y double"), ["x"], "y", trees=2)
    with pytest.raises(ValueError, match="no rows"):
        models.fit_direction(spark.createDataFrame([], "x double, y double"), ["x"], "y", trees=2)
    same = models.fit_direction(spark.createDataFrame([(1.0, 1.0)] * 5, "x double, y double"), ["x"], "y", trees=2, depth=0)
    assert same.classes(np.array([[3.0]])) == [1.0]
