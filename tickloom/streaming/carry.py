"""Per-key memory between micro-batches, and idempotent batch output.

A micro-batch is a static DataFrame, so the hot-safe series plans work on it.
What later batches need (one row per key) is written per batch id next to the
checkpoint.  A repeated batch reads the same earlier state and overwrites its
own folders, so a lost driver or executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame, "DataFrame | None"], tuple[DataFrame, DataFrame]]


KEEP_STATES = 10


def _forget(df: DataFrame, path: str) -> None:
    """Remove a state folder no restart can ask for any more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_with_carry(stream: DataFrame, step: Step, out: str, state: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start ``step(batch, carried) -> (rows, carried)`` on every micro-batch.

    Rows go to ``out/batch=<id>``.  Bound a batch at the source
    (maxFilesPerTrigger, maxOffsetsPerTrigger).  A batch always needs the state
    of the one before it; the last ``KEEP_STATES`` are kept.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        carried = batch.sparkSession.read.parquet(f"{state}/{batch_id - 1}") if batch_id > 0 else None
        rows, after = step(batch, carried)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        if batch_id >= KEEP_STATES:
            _forget(batch, f"{state}/{batch_id - KEEP_STATES}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_updates(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the rows an update-mode aggregate changed, per batch; ``latest`` keeps the newest per key."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def run_append(stream: DataFrame, out: str, checkpoint: str, by: Sequence[str] = (), **trigger) -> StreamingQuery:
    """Append the rows to ``out``, a folder for each value of the columns ``by``."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*by).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def run_split(stream: DataFrame, fault: str, good: str, bad: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Send rows with a fault to the dead-letter folder, the rest to ``good``; the batch is computed once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.filter(F.col(fault).isNull()).drop(fault).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            batch.filter(F.col(fault).isNotNull()).withColumn("failed_at", F.current_timestamp()).write.mode("overwrite").parquet(
                f"{bad}/batch={batch_id}"
            )
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_handlers(stream: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Call the handler registered for each message kind with its rows of the batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, handler in handlers.items():
                handler(batch.filter(F.col(kind) == name), batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
