"""Exact work over a total order when one key may hold most of the rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here rows are
range-partitioned by (key, order), numbered, and then handled in chunks of
bounded size; chunks overlap by the rows a frame looks back on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace import session

CHUNK_ROWS = 1_000_000
_PLACE_BITS = 33  # monotonically_increasing_id: partition number above 33 row bits


def _placed(df: DataFrame, order: list) -> DataFrame:
    """Rows with ``_part`` and ``_index``: their partition in the total order, and their place in it.

    One range shuffle. The placed rows are checkpointed, so that what is counted and
    what is numbered come from the same placement even when executors are lost.
    """
    session.checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_place", _PLACE_BITS))
        .withColumn("_index", F.col("_place").bitwiseAND(2 ** _PLACE_BITS - 1))
        .drop("_place")
    )


def number_rows(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """Number all rows from 1 in the given total order."""
    placed = _placed(df, order)
    # One row per shuffle partition: small whatever the data size.
    per_part = placed.groupBy("_part").agg((F.max("_index") + 1).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_index") + 1)
        .drop("_part", "_index", "_offset")
    )


def in_chunks(df: DataFrame, number: str, lookback: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Give every row its ``_chunk``, and copy the last ``lookback`` rows of a
    chunk to the next one, where ``_own`` is false."""
    size = max(chunk_rows, lookback, 1)
    first = F.floor((F.col(number) - 1) / size)
    last = F.floor((F.col(number) - 1 + lookback) / size)
    return (
        df.withColumn("_home", first)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def with_previous(df: DataFrame, keys: list[str], order: list, columns: list[str],
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``previous_<column>`` from the preceding row of the same keys."""
    numbered = number_rows(df, [*keys, *order], "_number")
    window = Window.partitionBy("_chunk", *keys).orderBy("_number")
    spread = in_chunks(numbered, "_number", 1, chunk_rows)
    for column in columns:
        spread = spread.withColumn(f"previous_{column}", F.lag(column).over(window))
    return spread.where("_own").drop("_number", "_chunk", "_own")


def moving_average(df: DataFrame, keys: list[str], order: list, value: str, rows: int,
                   name: str = "moving_avg", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean of ``value`` over this row and the ``rows - 1`` before it, per key."""
    numbered = number_rows(df, [*keys, *order], "_number")
    window = (
        Window.partitionBy("_chunk", *keys).orderBy("_number").rowsBetween(-(rows - 1), 0)
    )
    return (
        in_chunks(numbered, "_number", rows - 1, chunk_rows)
        .withColumn(name, F.avg(value).over(window))
        .where("_own").drop("_number", "_chunk", "_own")
    )


def running_total(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Add ``running`` (cumulative sum within the keys), ``total`` (key sum) and
    ``members`` (rows of the key).

    Sums run within a partition of the total order. A key that goes on into the next
    partition is the last of its own, so there are fewer of them than partitions: what
    they hold in each partition is carried forward from a table of that size.
    """
    placed = _placed(df, [*keys, *order])
    group = Window.partitionBy("_part", *keys)
    so_far = group.orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    local = (
        placed.withColumn("_running", F.sum(value).over(so_far))
        .withColumn("_local", F.sum(value).over(group))
        .withColumn("_rows", F.count("*").over(group))
    )
    borders = placed.groupBy("_part").agg(F.max_by(F.struct(*keys), "_index").alias("_last"))
    last = borders.select(*[F.col("_last")[k].alias(f"_k_{k}") for k in keys]).distinct()
    same_key: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    pieces = placed.join(F.broadcast(last), same_key).groupBy("_part", *[f"_k_{k}" for k in keys]).agg(
        F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    of_key = Window.partitionBy(*[f"_k_{k}" for k in keys])
    earlier = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        F.col("_part").alias("_p"), *[f"_k_{k}" for k in keys], F.sum("_sum").over(earlier).alias("_before"),
        F.sum("_sum").over(of_key).alias("_whole"), F.sum("_n").over(of_key).alias("_all"))
    return (
        local.join(F.broadcast(carried), same_key & (F.col("_part") == F.col("_p")), "left")
        .withColumn("running", F.col("_running") + F.coalesce("_before", F.lit(0)))
        .withColumn("total", F.coalesce("_whole", "_local"))
        .withColumn("members", F.coalesce("_all", "_rows"))
        .select(*df.columns, "running", "total", "members")
    )


def carry_last(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """Add ``name``: the last ``value`` that is not NULL, up to and with this row, of the same keys.

    Found within a partition of the total order. A key that goes on into the next
    partition is the last of its own, so there are fewer of them than partitions: the
    value each of them ends with in a partition is carried on from a table of that size.
    """
    placed = _placed(df, [*keys, *order])
    so_far = Window.partitionBy("_part", *keys).orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.last(value, ignorenulls=True).over(so_far))
    borders = placed.groupBy("_part").agg(F.max_by(F.struct(*keys), "_index").alias("_last"))
    last = borders.select(*[F.col("_last")[k].alias(f"_k_{k}") for k in keys]).distinct()
    same_key: Column = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    pieces = placed.join(F.broadcast(last), same_key).groupBy("_part", *[f"_k_{k}" for k in keys]).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_index"))).alias("_end"))
    earlier = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        F.col("_part").alias("_p"), *[f"_k_{k}" for k in keys], F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return (
        local.join(F.broadcast(carried), same_key & (F.col("_part") == F.col("_p")), "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .select(*df.columns, name)
    )


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
          columns: list[str]) -> DataFrame:
    """The rows of ``left`` with ``columns`` of the last row of ``right`` that has the same
    keys and is not later; NULL where there is none.

    Both sides lie in one total order, so a key of any size is spread over tasks. Of
    equal times the row with the largest ``columns`` is the last. NULL keys and times
    match nothing.
    """
    known = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, right_time]]))
    facts = known.select(
        *keys, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.struct(*columns).alias("_fact"),
        F.lit(None).cast(left.schema).alias("_row"))
    asked = left.select(
        *keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"),
        F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"), F.struct(*left.columns).alias("_row"))
    met = carry_last(facts.unionByName(asked), keys, ["_time", "_side", "_fact"], "_fact", "_found")
    return met.where("_side = 1").select("_row.*", *[F.col("_found")[c].alias(c) for c in columns])


CUT_BUCKETS = 200


def cut_off(values: DataFrame, value: str, rows: int, rounds: int = 8) -> float | None:
    """A value that at least ``rows`` rows reach or exceed, and few more; None if there are fewer.

    Each round counts the rows in equal steps of the range in question and goes on in
    the step that the row falls into. Only these counts come to the driver.
    """
    numbers = values.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    low, high, total = numbers.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if total < rows or low is None:
        return None
    above, inside = 0, numbers
    for _ in range(rounds):
        width = (high - low) / CUT_BUCKETS
        slack = 1e-12 * max(abs(low), abs(high))
        if not width > 2 * slack:
            break
        step = F.least(F.floor((F.col("v") - low) / width), F.lit(CUT_BUCKETS - 1)).cast("int")
        counts = dict(inside.groupBy(step.alias("s")).count().collect())
        taken, last = CUT_BUCKETS, 0
        while above < rows and taken > 0:
            taken -= 1
            last = counts.get(taken, 0)
            above += last
        # Rounding may leave a row at a border uncounted, which only takes in more rows.
        low, high = low + taken * width - slack, low + (taken + 1) * width - slack
        if above <= 2 * rows:
            break
        above -= last
        inside = numbers.where((F.col("v") >= low) & (F.col("v") < high))
    return low


def newest(df: DataFrame, order: list, rows: int) -> DataFrame:
    """The ``rows`` last rows of a total order that begins with a number or a time.

    A few narrow passes find a value of the first order column beyond which hardly
    more than ``rows`` rows lie; only these are sorted, in ranges. Exact for any number.
    """
    name = "_order"
    first = F.col(order[0]) if isinstance(order[0], str) else order[0]
    bound = cut_off(df.select(first.alias(name)), name, rows)
    near = df if bound is None else df.where(first.cast("double") >= F.lit(bound))
    latest_first = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    return number_rows(near, latest_first, "_rank").where(F.col("_rank") <= rows).drop("_rank")
