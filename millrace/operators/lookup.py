"""Bounded lists per group, and partitions of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators.ordered import number_rows

PAGE_ROWS = 100_000
#: Rows that one task hashes or sorts, about.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` placed by keys in partitions of about ``TASK_ROWS`` rows, of ``rows`` at most in all.

    For keys with few rows each: what a task holds stays the same however large the table
    is, where partitions that are joined again by their packed bytes grow with it.
    """
    places = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(places, *keys)


def group_lists(df: DataFrame, key: str, item: str, name: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Sorted item lists per key, as (key, page, size, list).

    Items are numbered within their key in item order; a page holds ``page_rows`` of
    them, the last one the rest. The pages of a key in order are its whole sorted
    list, and no task holds more than a page, equal items included. ``size`` is the
    number of items of the key.
    """
    numbered = number_rows(df.select(key, item), [key, item], "_number")
    firsts = numbered.groupBy(F.col(key).alias("_key")).agg(
        F.min("_number").alias("_first"), F.count("*").alias("size"))
    page = F.floor((F.col("_number") - F.col("_first")) / page_rows).cast("int")
    return (
        numbered.join(firsts, F.col(key).eqNullSafe(F.col("_key")))
        .groupBy(key, page.alias("page"))
        .agg(F.max("size").alias("size"), F.array_sort(F.collect_list(item)).alias(name))
    )
