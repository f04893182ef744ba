import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tickloom import build_session

    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def hot_ticks(spark):
    """Ticks in which one symbol holds about a third of the rows."""
    from pyspark.sql import functions as F

    from tickloom.sources.standins import ticks

    t = ticks(spark, SF)
    return t.withColumn("symbol", F.when(F.col("symbol").cast("int") < 6, "hot").otherwise(F.col("symbol")))


def same(a, b, places=7):
    """Compare two frames as sorted rows, doubles to some places."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def plain(df):
        out = []
        for r in df.select(*cols).collect():
            out.append(tuple(round(x, places) + 0.0 if isinstance(x, float) else x for x in r))
        return sorted(out, key=str)

    x, y = plain(a), plain(b)
    assert len(x) == len(y)
    for p, q in zip(x, y):
        for u, v in zip(p, q):
            if isinstance(u, float) and isinstance(v, float):
                assert u == pytest.approx(v, rel=1e-9, abs=10**-places)
            else:
                assert u == v
