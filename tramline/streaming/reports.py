"""Windowed reports of ride telemetry streams and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_repeats(stream: DataFrame, keys: list[str], event_ts: str = "event_ts", watermark: str = "10 seconds") -> DataFrame:
    """Rows of a stream without repeats of the keys inside the watermark."""
    return stream.withWatermark(event_ts, watermark).dropDuplicatesWithinWatermark(keys)


def window_report(df: DataFrame, keys: list[str], event_ts: str = "event_ts", size: str = "10 seconds", slide: str | None = None, watermark: str | None = "10 seconds") -> DataFrame:
    """Count, mean and top speed in tumbling or sliding windows."""
    d = df.withWatermark(event_ts, watermark) if watermark and df.isStreaming else df
    return d.groupBy(*keys, F.window(event_ts, size, slide or size).alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("top_speed")).select(*keys, "w.start", "w.end", "n", "mean_speed", "top_speed")


def session_report(df: DataFrame, keys: list[str], event_ts: str = "event_ts", gap: str = "15 seconds", watermark: str | None = "10 seconds") -> DataFrame:
    """The same for sessions, which end where nothing follows for `gap`."""
    d = df.withWatermark(event_ts, watermark) if watermark and df.isStreaming else df
    return d.groupBy(*keys, F.session_window(event_ts, gap).alias("w")).agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("top_speed")).select(*keys, "w.start", "w.end", "n", "mean_speed", "top_speed")
