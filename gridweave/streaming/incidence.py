"""Incidence matrices of event streams (an extension of this library): entries per event-time window, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_incidence(events: DataFrame, ts: str, row: str, col: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, row, col, n): how often each row met each column in a window; state is dropped once the watermark passes.

    Works on streams and on batch tables alike. Partial counts are combined before the shuffle.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if events.isStreaming else e
    g = e.groupBy(F.window(ts, every), F.col(row).alias("row"), F.col(col).alias("col")).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "row", "col", "n")


def windowed_blocks(events: DataFrame, ts: str, row: str, col: str, width: int, height: int, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, brow, bcol, n): entries of each occupied block in a window, for numeric rows and columns."""
    e = events.select(ts, F.expr(f"`{row}` div {int(height)}").alias("brow"), F.expr(f"`{col}` div {int(width)}").alias("bcol"))
    out = windowed_incidence(e, ts, "brow", "bcol", every, late)
    return out.withColumnsRenamed({"row": "brow", "col": "bcol"})
