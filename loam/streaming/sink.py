"""Streams into tables: every micro-batch is one commit, written once however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.operators.table import Table


def batch_writer(table: Table, app: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch unless the log has it by application and number."""

    def write(batch: DataFrame, number: int) -> None:
        if table.log.last_batch(app) < number:
            table.append_now(batch, txn={"app": app, "batch": number})

    return write


def append_stream(stream: DataFrame, table: Table, app: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a stream into a table; trigger as of writeStream (availableNow=True by default)."""
    return stream.writeStream.foreachBatch(batch_writer(table, app)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Rows counted by event-time windows and keys; rows later than `lateness` are dropped. Columns: start, end, keys, n."""
    window = F.window(F.col(time_col), width, slide) if slide else F.window(F.col(time_col), width)
    counted = stream.withWatermark(time_col, lateness).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(stream: DataFrame, time_col: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """Rows counted by sessions of each key that end after a gap. Columns: start, end, keys, n."""
    counted = stream.withWatermark(time_col, lateness).groupBy(F.session_window(F.col(time_col), gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
