import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_documents():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base.replace(" ", "\n"), "en", "b", 1), (3, base + " tail", "en", None, None),
        (4, " ".join(base.split()[:118]), None, "b", 1), (5, None, "en", "a", None), (6, "", "en", "a", 0), (7, " \t\n", "de", "c", 3),
        (8, "one two", "en", "c", 7), (9, "ONE two", "en", "c", 7), (10, "one two three four five", "en", "c", 1), (None, "no id here at all now", "en", "a", 1),
        (None, None, None, None, None), (12, "repeat me please as often as you can", "en", "a", 1), (12, "repeat me please as often as you can", "en", "a", 1),
        (12, "same id, other text, longer than before", "fr", "a", 1), (13, "é漢字 🙂 don't\x1cx\x85y  z", "zz", "é", 1), (14, "x" * 3000, "en", "a", 1),
        (15, words(rng, 20_000), "en", "a", 1), (16, "Released under the MIT License. cc by nc cc by nc", "en", "d", 1),
    ]
    rows += [(100 + i, words(rng, rng.randrange(1, 60)), rng.choice(["en", "de"]), rng.choice("abcd"), 5) for i in range(40)]
    rows += [(200 + i, base + " " + words(rng, i), "en", "a", 5) for i in range(30)]
    return rows


CLASH = ("run", "row", "digest", "size", "source_size", "target", "taken", "node", "label", "kept", "n_words", "start", "words", "toxic", "__doc", "__gone", "batch", "key")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents(), SCHEMA).repartition(5)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 230)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
