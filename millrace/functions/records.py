"""JSON and nested-record columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace import schemas


def json_text_field(raw: Column, field: str) -> Column:
    return F.get_json_object(raw, f"$.{field}")


def parse(raw: Column, ddl: str) -> Column:
    return F.from_json(raw, ddl)


def parse_event(raw: Column) -> Column:
    return F.from_json(raw, schemas.EVENT)


def to_compact_json(record: Column) -> Column:
    """JSON text without absent fields."""
    return F.to_json(record)


def unwrap_payload(raw: Column) -> Column:
    """The change event itself, whether or not it is wrapped in ``payload``."""
    return F.coalesce(F.get_json_object(raw, "$.payload"), raw)


def long_keys(odds: Column) -> Column:
    """Re-key a map with number texts as keys by the numbers."""
    return F.transform_keys(odds, lambda key, _: key.cast("long"))


def first_winner(races: Column) -> Column:
    """Winner of the first race, or the sentinel horse."""
    sentinel = F.struct(
        F.lit(schemas.NO_WINNER_NAME).alias("name"), F.lit(schemas.NO_WINNER_ID).alias("id")
    )
    return F.coalesce(F.try_element_at(races, F.lit(1))["winner"], sentinel)
