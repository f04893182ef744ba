"""Counts of a stream as a table: rows read, late rows, and whatever the stream observes.

``seen`` puts a named count into a plan; a ``Counts`` listener gathers what each
batch reports.  Late rows are those that a stateful operator dropped because the
watermark had passed their time.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, input_rows long, late_rows long, counts map<string, bigint>"


def seen(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """Observe the number of rows as ``name.rows`` and of those for which a condition holds as ``name.<condition>``."""
    more = [F.count_if(c).alias(k) for k, c in counts.items()]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *more)


class Counts(StreamingQueryListener):
    """Rows of ``SCHEMA``, one for each batch of the queries of a session while it is attached."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows, self._ended, self._changed = spark, [], set(), threading.Condition()

    def __enter__(self) -> Counts:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {f"{name}.{c}": int(row[c]) for name, row in p.observedMetrics.items() for c in row.asDict()}
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        with self._changed:
            self.rows.append((str(p.id), str(p.runId), p.batchId, p.numInputRows, late, counts))

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def finished(self, query, seconds: float = 60) -> None:
        """Wait for the query, and for the last of its reports."""
        query.awaitTermination()
        with self._changed:
            if not self._changed.wait_for(lambda: str(query.runId) in self._ended, seconds):
                raise TimeoutError("the query's end was not reported")

    def table(self) -> DataFrame:
        """What was reported: a row for each batch, batches without rows too."""
        with self._changed:
            return self.spark.createDataFrame(list(self.rows), SCHEMA)

    def totals(self) -> Mapping[str, int]:
        """Sums over all batches."""
        with self._changed:
            out = {"input_rows": sum(r[3] for r in self.rows), "late_rows": sum(r[4] for r in self.rows)}
            for r in self.rows:
                for name, n in r[5].items():
                    out[name] = out.get(name, 0) + n
        return out
