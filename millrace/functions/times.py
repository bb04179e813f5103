"""Event-time columns. The session zone is UTC (see ``session.tune``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(time: Column) -> Column:
    return F.unix_millis(time)


def from_iso(text: Column) -> Column:
    """ISO local date-time text to a timestamp."""
    return F.to_timestamp(text)


def date_from_parts(parts: Column) -> Column:
    """A date from a struct (year, monthValue, dayOfMonth)."""
    return F.make_date(parts["year"], parts["monthValue"], parts["dayOfMonth"])


def time_from_parts(parts: Column) -> Column:
    """A timestamp from a struct down to the minute; seconds are not kept."""
    return F.make_timestamp(
        parts["year"], parts["monthValue"], parts["dayOfMonth"],
        parts["hour"], parts["minute"], F.lit(0),
    )


def clock_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss")


def replay_ms(offset: Column, start_ms: int, ms_per_unit: int = 250) -> Column:
    """Epoch ms of a replayed point: the start plus the scaled offset."""
    return F.lit(start_ms).cast("long") + offset.cast("long") * F.lit(ms_per_unit)
