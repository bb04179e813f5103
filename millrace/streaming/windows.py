"""Watermarked windows. Results appear once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import trend, windows

TRAFFIC_LAG = "300 minutes"
POST_LAG = "1 second"


def trend_stream(counts: DataFrame, lag: str = TRAFFIC_LAG) -> DataFrame:
    """Linear trend over sliding windows of a (location, time, count) stream."""
    return trend.linear_trend(counts.withWatermark("time", lag))


def count_stream(events: DataFrame, location: str, time: str, width: str = "15 minutes",
                 lag: str = TRAFFIC_LAG) -> DataFrame:
    """Rows per location and closed interval, stamped within the interval, so that a
    further window can follow in the same query."""
    return (
        events.withWatermark(time, lag)
        .groupBy(F.col(location).alias("location"), F.window(time, width))
        .agg(F.count("*").alias("count"))
        .select("location", F.window_time("window").alias("time"), "count")
    )


def pane_stream(scored: DataFrame, key: str, time: str, value: str, slide_ms: int,
                lag: str = POST_LAG) -> DataFrame:
    """Sums per key and pane, from which sliding windows of any size are combined.

    State is one row per open pane, whatever the window size.
    """
    slide = f"{slide_ms} milliseconds"
    return (
        scored.withWatermark(time, lag).where(F.col(value).isNotNull())
        .groupBy(key, F.window(time, slide).alias("_slot"))
        .agg(F.sum(value).alias("sum"), F.count("*").alias("count"))
        .select(key, F.floor(F.unix_millis("_slot.start") / slide_ms).alias("pane"), "sum", "count")
    )


def best_stream(frames: DataFrame, time: str, width: str, score: str, ties: list[str],
                keep: list[str], lag: str) -> DataFrame:
    return windows.tumbling_best(frames.withWatermark(time, lag), time, width, score, ties, keep)


def downsample_stream(df: DataFrame, keys: list[str], time: str, interval: str, ties: list[str],
                      lag: str) -> DataFrame:
    return windows.downsample(df.withWatermark(time, lag), keys, time, interval, ties)


def in_time_rows(df: DataFrame, key: str, time: str, width: str = "1 second",
                 lateness: str = "1 second") -> DataFrame:
    """Rows with their fixed window, emitted at once, each once, late ones dropped.

    ``key`` is unique, so the de-duplication only serves to apply the watermark.
    """
    return (
        df.withWatermark(time, lateness).dropDuplicates([key, time])
        .withColumn("window", F.window(time, width))
    )


def stamped_now(df: DataFrame, name: str = "ingested") -> DataFrame:
    """Ingestion time: one instant per micro-batch."""
    return df.withColumn(name, F.current_timestamp())
