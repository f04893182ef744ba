"""Prices of zero: returns, sizes and labels as the SQL of the queries has them."""

import math

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tickloom.operators import models, risk


@pytest.fixture
def zero_dir(spark, sf, tmp_path):
    """The smallest tables, with some events at a price of zero."""
    import shutil
    from pathlib import Path

    for f in Path(sf).glob("*.parquet"):
        if f.name != "events.parquet":
            shutil.copy(f, tmp_path / f.name)
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    events.loc[events["event_id"] % 97 == 5, "value"] = 0.0
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", index=False)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["returns", "winsorise_returns", "forward_label"])
def test_zero_prices_against_sql(name, spark, zero_dir):
    assert compare(entry.queries()[name](spark, zero_dir), connect(zero_dir), entry.oracle_sql()[name]) is None


def test_no_size_at_a_price_of_zero(spark):
    signals = spark.createDataFrame([("A", 0.0, 1.0, 0.5), ("A", 10.0, -1.0, 0.5)], "symbol string, price double, strength double, volatility double")
    held = spark.createDataFrame([("A", 0.0)], "symbol string, market_value double")
    got = {r.price: r["size"] for r in risk.position_sizing(signals, held, capital=1000.0).collect()}
    assert got == {0.0: None, 10.0: -2}


@pytest.mark.parametrize("name", ["fit_direction", "fit_magnitude"])
def test_models_are_fitted_beside_zero_prices(name, spark, zero_dir):
    rows = entry.queries()[name](spark, zero_dir).collect()
    assert len(rows) == 3 and all(r["rows"] > 0 and math.isfinite(r["score"]) for r in rows)


def test_rows_without_a_finite_label_are_not_fitted(spark):
    df = spark.createDataFrame([(float(i), y) for i, y in enumerate([1.0, None, float("inf"), 2.0, float("nan"), 1.5])], "x double, magnitude double")
    assert sorted(r.x for r in models._with_label(df, "magnitude").collect()) == [0.0, 3.0, 5.0]


def test_direction_is_scored_after_observed_counts(spark):
    """A session that has observed counts cannot be sent to tasks along with the model."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("rows")
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    rows = spark.createDataFrame([(float(i % 2), float(i)) for i in range(40)], "y double, x double")
    model = models.fit_direction(rows, ["x"], label="y", trees=3)
    assert len(models.predict(model, rows, ["x"]).repartition(3, "prediction").collect()) == 40
