"""Change events: raw latest, materialised current rows, text log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace import schemas
from millrace.functions.records import unwrap_payload

ORDER = ["file", "pos", "row"]


def parse_changes(raw: DataFrame, row_ddl: str = schemas.CUSTOMER_ROW) -> DataFrame:
    """(key, op, before, after, file, pos, row) from (key, value) texts, wrapped or bare.

    Delete markers (NULL values) carry no change and are left out.
    """
    event = F.from_json(unwrap_payload(F.col("value")), schemas.change_envelope(row_ddl))
    return (
        raw.where(F.col("value").isNotNull())
        .select(unwrap_payload(F.col("key")).alias("key"), event.alias("e"))
        .select("key", "e.op", "e.before", "e.after", "e.source.file", "e.source.pos", "e.source.row")
    )


def current_rows(changes: DataFrame) -> DataFrame:
    """The table the changes describe: last change per key wins, deletes remove.

    Changes are ordered by their log position; snapshot rows have no usable time.
    """
    last = F.max_by(F.struct("op", "after"), F.struct(*ORDER))
    return (
        changes.groupBy("key").agg(last.alias("_last"))
        .where(F.col("_last.op") != "d").select("key", "_last.after.*")
    )


def raw_latest(raw: DataFrame, order: list[str]) -> DataFrame:
    """Newest raw envelope per key, unopened."""
    return raw.groupBy("key").agg(F.max_by("value", F.struct(*order)).alias("value"))


def log_lines(raw: DataFrame) -> DataFrame:
    """Key and value as text, one line per change."""
    return raw.withColumn("line", F.format_string(
        "(%s,%s)", F.coalesce("key", F.lit("null")), F.coalesce("value", F.lit("null"))))
