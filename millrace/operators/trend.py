"""Counts per interval, linear trend over sliding windows, short forecast."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.numbers import round_half_up
from millrace.functions.times import epoch_ms

STEP_MS = 15 * 60 * 1000
WEEK = "7 days"

#: Windows of one location that are computed together in a batch.
STRETCH_WINDOWS = 960


def interval_counts(events: DataFrame, location: str, time: str, width: str = "15 minutes") -> DataFrame:
    """Rows per location and interval, stamped with the interval start."""
    return (
        events.groupBy(F.col(location).alias("location"), F.window(time, width))
        .agg(F.count("*").alias("count"))
        .select("location", F.col("window.start").alias("time"), "count")
    )


def _ms(width: str) -> int:
    """Milliseconds of a fixed interval such as ``15 minutes``."""
    return int(pd.Timedelta(width) // pd.Timedelta(milliseconds=1))


def pane_moments(counts: DataFrame, width: str) -> DataFrame:
    """(location, pane, n, mx, my, sxx, sxy, low, high): moments of the counts of each pane.

    mx, low and high are mean, first and last time in ms after the pane's start, so no digits
    are lost to the size of epoch times; sxx and sxy are sums of products of deviations.
    """
    x = F.pmod(epoch_ms(F.col("time")), F.lit(_ms(width))).cast("double")
    y = F.col("count").cast("double")
    n = F.count(y)
    return (
        counts.where("time IS NOT NULL AND count IS NOT NULL")
        .groupBy("location", F.window("time", width).alias("pane"))
        .agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (n * F.var_pop(x)).alias("sxx"),
             (n * F.covar_pop(x, y)).alias("sxy"), F.min(x).alias("low"), F.max(x).alias("high"))
    )


def _merged(start: Column, end: Column) -> list[Column]:
    """Sums over the panes of a window, their times counted back from its end."""
    after = (start - end).cast("double")
    x, n = after + F.col("mx"), F.col("n")
    return [
        F.sum("n").alias("n"), F.sum(n * x).alias("x"), F.sum(n * F.col("my")).alias("y"),
        F.sum(F.col("sxx") + n * x * x).alias("xx"), F.sum(F.col("sxy") + n * x * F.col("my")).alias("xy"),
        F.min(after + F.col("low")).alias("low"), F.max(after + F.col("high")).alias("high")]


def linear_trend(counts: DataFrame, size: str = "120 minutes", slide: str = "15 minutes") -> DataFrame:
    """Least-squares slope of the count per ms, keyed by location and window end.

    NULL where a window has a single time in it; rows without a time or count do not take part.
    Rows become moments of panes, and a window's slope comes from those of its panes, however
    many rows they have. In a batch, panes are dealt by location and stretch of time, and only
    the panes that reach into the next stretch go twice: the windows need no shuffle of their own.
    A stream keeps a row per open pane and one per open window.
    """
    size_ms, slide_ms = _ms(size), _ms(slide)
    panes = pane_moments(counts, f"{math.gcd(size_ms, slide_ms)} milliseconds")
    slope = F.when(F.col("high") > F.col("low"), (F.col("xy") - F.col("x") * F.col("y") / F.col("n"))
                   / (F.col("xx") - F.col("x") * F.col("x") / F.col("n"))).alias("slope")
    if counts.isStreaming:
        placed = panes.select("*", F.window(F.window_time("pane"), size, slide).alias("window"))
        return placed.groupBy("location", "window").agg(
            *_merged(epoch_ms(F.col("pane.start")), epoch_ms(F.col("window.end")))
        ).select("location", F.col("window.end").alias("window_end"), slope)
    # A stretch holds the windows that start in it; a pane goes to all stretches its windows start in.
    stretch_ms = STRETCH_WINDOWS * slide_ms
    start = epoch_ms(F.col("pane.start"))
    first, last = (F.floor((start - size_ms) / slide_ms) + 1) * slide_ms, F.floor(start / slide_ms) * slide_ms
    dealt = panes.withColumns({"start": start, "first": first, "last": last}).drop("pane").where("first <= last").withColumn(
        "stretch", F.explode(F.sequence(F.floor(F.col("first") / stretch_ms), F.floor(F.col("last") / stretch_ms)))
    ).repartition("location", "stretch")
    low, high = F.col("stretch") * stretch_ms, (F.col("stretch") + 1) * stretch_ms - slide_ms
    starts = F.sequence(F.greatest("first", low), F.least("last", high), F.lit(slide_ms).cast("long"))
    return dealt.withColumn("begin", F.explode(starts)).withColumn("end", F.col("begin") + size_ms).groupBy("location", "stretch", "end").agg(
        *_merged(F.col("start"), F.col("end"))
    ).select("location", F.timestamp_millis("end").alias("window_end"), slope)


def forecast(counts: DataFrame, trends: DataFrame, steps: int = 8, step_ms: int = STEP_MS) -> DataFrame:
    """Extend each count along the trend that ended one week earlier.

    Without such a trend the count is repeated. The first value is the count
    itself although the row is stamped one step later. Values are rounded half
    up after cutting float noise below 1e-6.
    """
    week_ago = trends.select(
        "location", (F.col("window_end") + F.expr(f"INTERVAL {WEEK}")).alias("time"), "slope"
    )
    slope = F.coalesce("slope", F.lit(0.0))

    def step(i):
        value = F.col("count") + i * F.lit(float(step_ms)) * slope
        return round_half_up(F.round(value, 6)).cast("int")

    return counts.join(week_ago, ["location", "time"], "left").select(
        "location",
        F.timestamp_millis(epoch_ms(F.col("time")) + step_ms).alias("time"),
        F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), step).alias("predicted_counts"),
    )


def forecast_line(predictions: DataFrame) -> DataFrame:
    """Predictions as text lines for a file sink. The line's layout is a fixed value."""
    local = F.date_format("time", "yyyy-MM-dd'T'HH:mm")
    counts = F.array_join(F.col("predicted_counts").cast("array<string>"), ", ")
    return predictions.select(
        F.format_string(
            "Prediction{location='%s', time=%s (%d), predictedCounts=[%s]}",
            "location", local, epoch_ms(F.col("time")), counts,
        ).alias("value")
    )
