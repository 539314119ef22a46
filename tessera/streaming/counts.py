"""Matrix cells from streams: sums by (row, column) and time window, with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cells(events: DataFrame, ts: str, row: str, col: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, r, c, v): sums per tumbling window; works on streams and on tables alike."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(row).isNotNull() & F.col(col).isNotNull())
    d = d.withWatermark(ts, late) if events.isStreaming else d
    w = d.groupBy(F.window(ts, window).alias("w"), F.col(row).alias("r"), F.col(col).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("v"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "r", "c", "v")
