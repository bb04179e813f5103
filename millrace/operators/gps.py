"""Track points: replayed time, numbered JSON lines, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions.times import clock_text, replay_ms
from millrace.operators.ordered import CHUNK_ROWS, number_rows, with_previous

MIN_GAP = 10


def parse_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lat, lon, offset) from comma-separated lines."""
    parts = F.split(column, ",")
    return lines.select(
        parts[0].alias("lat"), parts[1].alias("lon"), parts[2].cast("long").alias("offset")
    )


def replay(points: DataFrame, start_ms: int, ms_per_unit: int = 250) -> DataFrame:
    """Stamp each point with the start time plus its scaled offset."""
    return points.withColumn("replay_ms", replay_ms(F.col("offset"), start_ms, ms_per_unit))


def point_json(points: DataFrame) -> DataFrame:
    """The point as a JSON line; its spacing and quotes are fixed values."""
    return points.withColumn("line", F.format_string(
        '{ "input-point": "%d", "latitude": "%s", "longitude": "%s", "timestamp": "%d", "timeprint": "%s" }',
        "input_point", "lat", "lon", "replay_ms", clock_text(F.col("replay_ms"))))


def reformat(points: DataFrame, order: list, start_ms: int, ms_per_unit: int = 250) -> DataFrame:
    """Number the points in order and write each as a JSON line."""
    numbered = number_rows(points, order, "input_point")
    return point_json(replay(numbered, start_ms, ms_per_unit))


def gaps(points: DataFrame, keys: list[str], order: list, offset: str = "offset",
         min_gap: int = MIN_GAP, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Points more than ``min_gap`` after the one before; backward steps count as 0."""
    previous = F.col(f"previous_{offset}")
    step = F.when(previous < 0, F.lit(0)).otherwise(F.greatest(F.col(offset) - previous, F.lit(0)))
    return (
        with_previous(points, keys, order, [offset], chunk_rows)
        .withColumn("gap", F.coalesce(step, F.lit(0)))
        .where(F.col("gap") > min_gap)
    )
