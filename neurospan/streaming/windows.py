"""Windows over event streams; an extension: batch tables and streams share the same code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(events: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, population std and range of values by window and key; late rows are dropped after the watermark."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    out = timed.groupBy(F.window(ts, size, slide).alias("w"), key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"),
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "mean", "std", "range")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key that are less than gap apart."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
