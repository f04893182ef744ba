"""User-defined filters, chunk functions, features and event functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.files import chunk_map

ChunkFunction = Callable[[pd.DataFrame], pd.DataFrame]

__all__ = ["chunk_map", "udf_filter", "udf_feature", "event_function"]


def udf_filter(df: DataFrame, column: str, test: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Filter by a vectorised predicate.  A function on Column needs no UDF: use ``filter_spec``."""

    def run(values: pd.Series) -> pd.Series:
        return test(values)

    return df.filter(F.pandas_udf(run, T.BooleanType())(F.col(column)))


def udf_feature(df: DataFrame, name: str, columns: Iterable[str], fn: Callable[..., pd.Series]) -> DataFrame:
    """A row-wise feature from Arrow batches of the given columns."""
    def run(batch: pd.DataFrame) -> pd.Series:
        return fn(**{c: batch[c] for c in batch.columns})

    packed: Column = F.struct(*columns)
    return df.withColumn(name, F.pandas_udf(run, T.DoubleType())(packed))


def event_function(df: DataFrame, function, *args: str) -> DataFrame:
    """One event to many rows: lateral join with a table function class."""
    return df.lateralJoin(function(*[F.col(a).outer() for a in args]))
