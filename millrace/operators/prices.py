"""Latest value per key, change history and change notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace import session
from millrace.functions.text import key_value_line, starts_with_ignoring_case
from millrace.operators.ordered import newest

JOURNAL_ROWS = 10_000


def latest_by_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in the given order."""
    others = [c for c in changes.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return changes.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def journal(changes: DataFrame, order: list[str], capacity: int = JOURNAL_ROWS) -> DataFrame:
    """The newest changes, all kept up to ``capacity``."""
    return newest(changes, order, capacity)


def history_lines(history: DataFrame, key: str, value: str, prefix: str = "p") -> DataFrame:
    """``key==value`` lines of the keys that start with ``prefix`` in any case.

    The prefix of the line is the prefix of its key, so the filter comes first.
    """
    return history.where(starts_with_ignoring_case(F.col(key), prefix)).withColumn(
        "line", key_value_line(F.col(key), F.col(value))
    )


# Fixed value: the text of a change notice.
NOTICE = "%s event, map '{table}', key '%s', new value '%s'"


def notice_line(table: str, kind: Column, key: str, value: str) -> Column:
    """The text of a change; NULL keys and values read ``null``."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (key, value)]
    return F.format_string(NOTICE.format(table=table), kind, *texts)


def change_notices(changes: DataFrame, table: str, key: str, value: str, order: str,
                   known: DataFrame | None = None) -> DataFrame:
    """A text per change: ADDED for the first of its key, else UPDATED.

    The first change per key is a small aggregate, so no key is sorted whole. Of equal
    smallest orders the smaller value came first, and of fully equal changes one.
    A NULL key is a key. ``known`` lists keys that were there before: they are only
    updated.
    """
    firsts = changes.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(order, value)).alias("_first"))
    if known is not None:
        there = known.select(F.col(key).alias("_there")).distinct()
        firsts = firsts.join(there, F.col("_key").eqNullSafe(F.col("_there")), "left_anti")
    marked = changes.join(firsts, F.col(key).eqNullSafe(F.col("_key")), "left")
    is_first = F.coalesce(F.struct(order, value) == F.col("_first"), F.lit(False))
    # Only the candidates for ADDED are numbered: one per key but for equal changes.
    candidates = marked.where(is_first).withColumn(
        "_place", F.row_number().over(Window.partitionBy("_key", order, value).orderBy(F.lit(0))))
    added = candidates.withColumn("kind", F.when(F.col("_place") == 1, "ADDED").otherwise("UPDATED")).drop("_place")
    updated = marked.where(~is_first).withColumn("kind", F.lit("UPDATED"))
    return added.unionByName(updated).withColumn("line", notice_line(table, F.col("kind"), key, value)).drop("_first", "_key")


def listing(latest: DataFrame, key: str, value: str) -> DataFrame:
    """Printed table: a line per key in key order, then the number of entries."""
    session.checkpoint_dir(latest.sparkSession)
    kept = latest.checkpoint()  # listed and counted from one state
    lines = kept.select(
        F.lit(0).alias("part"), F.col(key).cast("string").alias("key"),
        F.format_string("    -> '%s' -> %s", key, value).alias("line"),
    )
    entries = kept.agg(F.count("*").alias("n")).select(
        F.lit(1).alias("part"), F.lit(None).cast("string").alias("key"),
        F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" entr"),
                 F.when(F.col("n") == 1, F.lit("y")).otherwise(F.lit("ies")), F.lit("]")).alias("line"),
    )
    return lines.unionByName(entries).orderBy("part", "key")
