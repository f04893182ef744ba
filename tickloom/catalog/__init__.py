"""Every operator as a query over the test tables."""

from tickloom.catalog import aggregates, books, features, models, quality, risk, scalars, signals, sources, streams  # noqa: F401
from tickloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
