"""Numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves towards positive infinity (-2.5 -> -2)."""
    return F.floor(value + F.lit(0.5))


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false for NaN and both infinities."""
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def per_minute(count: Column, window_ms: Column) -> Column:
    """Events per minute of a count taken over ``window_ms``."""
    return count / (window_ms / F.lit(60_000.0))
