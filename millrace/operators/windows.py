"""Tumbling and sliding event-time windows.

A fine slide (30 s or 5 min by 200 ms) puts each row into 150 or 1,500 windows.
Rows are first summed into panes one slide long. A window result only changes
where a pane enters or leaves it, so results are computed per change point and
kept as segments of equal windows; single windows are unfolded last, without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators import ordered
from millrace.operators.lookup import spread

#: Marks that each pane makes.
PANE_MARKS = 3


def pane_sums(df: DataFrame, key: str, time_ms: str, value: str, slide_ms: int) -> DataFrame:
    """Sum and count per key and pane (``floor(time / slide)``)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key, F.floor(F.col(time_ms) / slide_ms).alias("pane"))
        .agg(F.sum(value).alias("sum"), F.count("*").alias("count"))
    )


def sliding_segments(df: DataFrame, key: str, time_ms: str, value: str, size_ms: int,
                     slide_ms: int) -> DataFrame:
    """Average and count over sliding windows, from rows; see ``segments_of_panes``."""
    return segments_of_panes(pane_sums(df, key, time_ms, value, slide_ms), key, size_ms, slide_ms, df.count())


def segments_of_panes(panes: DataFrame, key: str, size_ms: int, slide_ms: int, most: int | None = None) -> DataFrame:
    """Average and count over sliding windows, as (key, first_end, last_end, avg, count).

    All windows ending at ``first_end``, ``first_end + slide``, .. ``last_end``
    (epoch ms) share the result; empty windows are left out.

    Time is cut into blocks one window long. A window then holds what has entered
    so far in its own block and what has not left yet from the block before: two
    running sums, without subtraction, over at most three rows per pane and block.
    ``most``: a bound of the number of panes; with it tasks sort a fixed number of rows.
    """
    if size_ms % slide_ms:
        raise ValueError("the slide must divide the window size")
    length = size_ms // slide_ms
    pane, block = F.col("pane"), F.floor(F.col("pane") / length)
    none, zero = F.lit(0.0), F.lit(0).cast("long")

    def mark(of_block, position, entering, leaving):
        return F.struct(
            of_block.alias("_block"), position.alias("_pos"),
            entering[0].alias("_in_sum"), entering[1].alias("_in_count"),
            leaving[0].alias("_out_sum"), leaving[1].alias("_out_count"),
        )

    content, nothing = (F.col("sum"), F.col("count")), (none, zero)
    marks = panes.select(key, F.inline(F.array(
        mark(block, pane, content, nothing),
        mark(block + 1, pane + length, nothing, content),
        mark(block + 1, (block + 1) * length, nothing, nothing),  # windows run on into the block
    )))
    if most is not None:
        marks = spread(marks, PANE_MARKS * most, key, "_block")
    part = Window.partitionBy(key, "_block")
    entered = part.orderBy("_pos").rangeBetween(Window.unboundedPreceding, 0)
    staying = part.orderBy(F.desc("_pos")).rangeBetween(Window.unboundedPreceding, -1)

    def held(name: str) -> Column:
        return F.sum(f"_in_{name}").over(entered) + F.coalesce(F.sum(f"_out_{name}").over(staying), zero)

    block_end = (F.col("_block") + 1) * length
    following = F.coalesce(F.lead("_pos").over(part.orderBy("_pos")), block_end)
    return (
        marks.withColumn("_total", held("sum"))
        .withColumn("count", held("count"))
        .withColumn("_next", following)
        .where((F.col("count") > 0) & (F.col("_next") > F.col("_pos")))
        .select(
            key,
            ((F.col("_pos") + 1) * slide_ms).alias("first_end"),
            (F.col("_next") * slide_ms).alias("last_end"),
            (F.col("_total") / F.col("count")).alias("avg"),
            "count",
        )
    )


def unfold_segments(segments: DataFrame, slide_ms: int) -> DataFrame:
    """One row per window, with its ``window_end`` in epoch ms."""
    ends = F.sequence("first_end", "last_end", F.lit(slide_ms).cast("long"))
    others = [c for c in segments.columns if c not in ("first_end", "last_end")]
    return segments.select(*others, F.explode(ends).alias("window_end"))


DAY_MS = 86_400_000


def windows_per_day(segments: DataFrame, key: str, slide_ms: int) -> DataFrame:
    """(key, day, windows, total, most, mean) of the windows ending on each day.

    A segment is cut at the day border and its windows are counted by arithmetic; a
    segment is shorter than a day, as a window is.
    """
    day = F.floor(F.col("first_end") / DAY_MS)
    border = (day + 1) * DAY_MS

    def ends(first: Column, last: Column) -> Column:
        return F.floor((last - first) / slide_ms) + 1

    cut = segments.select(key, "avg", "count", F.inline(F.array(
        F.struct(day.alias("day"), ends(F.col("first_end"), F.least("last_end", border - slide_ms)).alias("windows")),
        F.struct((day + 1).alias("day"), F.greatest(ends(border, F.col("last_end")), F.lit(0).cast("long")).alias("windows")))))
    return cut.where("windows > 0").groupBy(key, "day").agg(
        F.sum("windows").alias("windows"), F.sum(F.col("count") * F.col("windows")).alias("total"),
        F.max("count").alias("most"), (F.sum(F.col("avg") * F.col("windows")) / F.sum("windows")).alias("mean"))


def latest_windows(panes: DataFrame, key: str, sizes: dict[str, int], slide_ms: int,
                   as_of_ms: int | None = None) -> DataFrame:
    """The last window with data per key and window name: what a keyed upsert holds.

    Of the windows that end by ``as_of_ms`` that is the one ending there, if it
    has data; by default, and for a key silent since, it is the one that its last
    pane leaves last, holding only that pane. One pass over the panes.
    """
    pane = F.col("pane")
    end = None if as_of_ms is None else as_of_ms // slide_ms
    known = panes if end is None else panes.where(pane < end)

    def within(column: str, size: int) -> Column:
        return F.sum(F.when(pane >= end - size // slide_ms, F.col(column)))

    sums = [F.max(pane).alias("_last"), F.max_by("sum", "pane").alias("_sum"), F.max_by("count", "pane").alias("_count")]
    for name, size in sizes.items():
        if end is not None:
            sums += [within("sum", size).alias(f"_sum_{name}"), within("count", size).alias(f"_count_{name}")]

    def window(name: str, size: int) -> Column:
        last = (F.col("_last") + size // slide_ms) * slide_ms
        total, count = F.col("_sum"), F.col("_count")
        if end is not None:
            last = F.least(last, F.lit(end * slide_ms))
            total = F.coalesce(f"_sum_{name}", total)
            count = F.coalesce(f"_count_{name}", count)
        return F.struct(F.lit(name).alias("window"), F.lit(size).cast("long").alias("size_ms"),
                        last.cast("long").alias("window_end"), (total / count).alias("avg"), count.alias("count"))

    windows = F.array(*[window(name, size) for name, size in sizes.items()])
    return known.groupBy(key).agg(*sums).select(key, F.inline(windows))


def tumbling_best(df: DataFrame, time: str, width: str, score: str, ties: list[str],
                  keep: list[str]) -> DataFrame:
    """Row with the highest score per tumbling window; ``ties`` break ties upwards."""
    best = F.max_by(F.struct(*keep), F.struct(score, *ties))
    return (
        df.groupBy(F.window(time, width)).agg(best.alias("_best"))
        .select(F.col("window.end").alias("window_end"), "_best.*")
    )


def downsample(df: DataFrame, keys: list[str], time: str, interval: str, ties: list[str]) -> DataFrame:
    """First row per key in every interval of a fixed grid."""
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(time, *ties))
    return (
        df.groupBy(*keys, F.window(time, interval).alias("_slot"))
        .agg(first.alias("_first")).select(*keys, "_first.*")
    )


def let_through(df: DataFrame, keys: list[str], time: str, interval_ms: int, ties: list[str]) -> DataFrame:
    """The rows that a rate limit lets through: the first per key, and then each time
    the first that lies at least ``interval_ms`` after the last one let through.

    Every row points to the first row of its key an interval later, found in one total
    order of rows and of the times asked for. The rows let through are those that the
    pointers reach from the first one: pointers over 2, 4, 8 ... steps are made by
    joining them with themselves, and the marks then spread in steps of halving size,
    so that the rounds grow with the logarithm of the longest chain and no key is
    walked in one task. Equal times go by ``ties``. Rows without a time are left out.
    """
    placed = ordered.number_rows(
        df.where(F.col(time).isNotNull()).withColumn("_all", F.lit(0)), ["_all", *keys, time, *ties], "_number")
    groups = ["_all", *keys]
    rows = placed.select(*groups, F.unix_micros(F.col(time).cast("timestamp")).alias("_us"), "_number")
    none = F.lit(None).cast("long")
    asked = rows.select(*groups, (F.col("_us") + interval_ms * 1000).alias("_us"), F.lit(1).alias("_side"),
                        none.alias("_number"), F.col("_number").alias("_from"))
    there = rows.select(*groups, "_us", F.lit(0).alias("_side"), "_number", none.alias("_from"))
    # From the last time to the first, so that the row carried on is the first one not earlier.
    backwards = [F.col("_us").desc(), "_side", F.col("_number").desc()]
    found = ordered.carry_last(there.union(asked), groups, backwards, "_number", "_to")
    steps = [found.where("_side = 1 AND _to IS NOT NULL").select("_from", "_to").checkpoint()]
    while not steps[-1].isEmpty():
        onwards = steps[-1].select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        steps.append(steps[-1].join(onwards, "_to").select("_from", F.col("_next").alias("_to")).checkpoint())
    through = rows.groupBy(*groups).agg(F.min("_number").alias("_from")).select("_from")
    for step in reversed(steps[:-1]):
        through = through.union(through.join(step, "_from").select("_to")).checkpoint()
    return placed.join(through.withColumnRenamed("_from", "_number"), "_number", "left_semi").select(*df.columns)
