"""Mixing sources to target weights along a time-varying curriculum.

A source takes part in training by a schedule: its rate over the time 0 to 1, given
as knots with straight lines between. The integral of the rate is the source's
demand for words. A source's documents follow one another in the order of a hash;
the middle of a document in this stream is a number of words, and the time at which
the demand has reached that number is the document's training position. Documents
are sorted by position in ranges.

How much a source gives in all is its target: the words of the whole mix shared by
weight, but no source over ``MOST`` times its size; what it cannot give is shared
again among the others by weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.registry import keep
from millrace.llm.running import spread, totals_before

#: A source gives its documents so many times at most.
MOST = 3

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Share:
    """Weight of a source, and its rate over time as (time, rate) knots from 0 to 1."""

    weight: int
    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))


#: Sources in code point order take these shares in turn: the first kind early, the others late.
SHARES = (
    Share(5, ((0.0, 1.5), (1.0, 0.5))),
    Share(2),
    Share(1, ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0))),
)


def demand_inverse(done: F.Column, knots: tuple[tuple[float, float], ...]) -> F.Column:
    """The time at which the share ``done`` (0 to 1) of the whole demand is reached."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
    whole = sum(areas)
    time, start = F.lit(float(knots[0][0])), 0.0
    for area, (t0, r0), (t1, r1) in zip(areas, knots, knots[1:], strict=False):
        inside = F.greatest(done * whole - start, F.lit(0.0))
        slope = (r1 - r0) / (t1 - t0)
        # rate r0 rising by slope: r0 x + slope x^2 / 2 = inside, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * slope * inside, F.lit(0.0)))
        step = 2 * inside / F.greatest(r0 + root, F.lit(1e-300))
        time = F.when(done * whole > start, t0 + F.least(step, F.lit(t1 - t0))).otherwise(time)
        start += area
    return time


def targets(sizes: DataFrame, source: str, shares: tuple[Share, ...] = SHARES, most: int = MOST) -> DataFrame:
    """(source, source_size, kind, target) from (source, source_size): one row per source.

    Sources are few beside documents; their order is found in one window. The sources
    that reach their limit are a prefix in the order of limit over weight.
    """
    everything = Window.orderBy(F.col(source).asc_nulls_last())
    kind = (F.row_number().over(everything) - 1) % len(shares)
    weights = F.element_at(F.array(*[F.lit(s.weight).cast("long") for s in shares]), F.col("kind") + 1)
    ranked = sizes.withColumn("kind", kind).withColumn("weight", weights).withColumn("limit", F.col("source_size") * most)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col(source).asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    full = left * F.col("weight") > F.col("limit") * F.sum("weight").over(after)
    marked = ranked.withColumn("full", full)
    full_limits = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(whole)
    open_weights = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    shared = ((F.sum("source_size").over(whole) - full_limits) * F.col("weight")).cast("double") / open_weights
    return marked.select(
        source, "source_size", "kind", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def plan(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    shares: tuple[Share, ...] = SHARES, most: int = MOST,
) -> DataFrame:
    """(key, source, text_hash, first, rows, size, source_size, target, taken, positions) of every document.

    A document is a key, source and text; ``rows`` is how often the table repeats it,
    and its size counts that often. Every row goes in whole, target / source_size
    times rounded down, and those first in the order of the hash once more until the
    target is met to half a row. If that end falls inside a document, its rows come in
    two parts, ``first`` rows of it before the part. ``positions`` are the training
    positions of a row's copies, ``taken`` the words they hold. Null text: size 0. A null
    source is a source of its own, a null key a key like any other. A source without
    words gives nothing.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    units = keep(
        docs.select(key, source, F.xxhash64(text).alias("text_hash"), words.alias("size"))
        .groupBy(key, source, "text_hash", "size").agg(F.count("*").alias("rows"))
        .withColumn("mass", F.col("size") * F.col("rows"))
        .withColumn("spread", spread(key)), "units")
    aims = keep(targets(units.groupBy(source).agg(F.sum("mass").alias("source_size")), source, shares, most), "targets")
    aims = aims.withColumnRenamed(source, "of_source")
    ordered = totals_before(units, [source], "spread", [key, "size", "text_hash"], "mass", "before")
    times = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    with_aims = ordered.join(aims, F.col(source).eqNullSafe(F.col("of_source"))).withColumn("times", times)
    rest = F.col("target") - F.col("times") * F.col("source_size")

    def once_more(number: Column) -> Column:
        """Whether the middle of the row with this number, from 0, lies before the end."""
        return F.col("before") + number * F.col("size") + F.col("size") / 2 <= rest

    about = F.floor(F.coalesce(F.try_divide(rest - F.col("before"), "size"), F.lit(0.0)) + 0.5)
    near = F.least(F.greatest(about, F.lit(0)), F.col("rows"))
    # The division may round to the other side of the end: the row itself decides.
    more = F.when((near > 0) & ~once_more(near - 1), near - 1).when((near < F.col("rows")) & once_more(near), near + 1).otherwise(near)
    part = F.explode(F.filter(
        F.array(*[F.struct(a.alias("first"), (b - a).alias("rows"), F.lit(x).alias("more")) for a, b, x in (
            (F.lit(0).cast("long"), F.col("ends"), 1), (F.col("ends"), F.col("rows"), 0))]),
        lambda p: p["rows"] > 0))
    parts = with_aims.withColumn("ends", F.when(F.col("size") > 0, more.cast("long")).otherwise(0)).withColumn("part", part).withColumns({
        "first": F.col("part.first"), "rows": F.col("part.rows"), "mass": F.col("size") * F.col("part.rows"),
        "copies": (F.col("times") + F.col("part.more")) * (F.col("size") > 0).cast("long")})
    middle = F.col("before") + F.col("first") * F.col("size") + F.col("mass") / 2
    done = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("copies") - 1),
        lambda i: F.least((i * F.col("source_size") + middle) / F.col("target"), F.lit(1.0)))

    def placed(x: F.Column) -> F.Column:
        by_kind = F.lit(0.0)
        for i, share in enumerate(shares):
            by_kind = F.when(F.col("kind") == i, demand_inverse(x, share.knots)).otherwise(by_kind)
        return by_kind

    positions = F.when(F.col("copies") > 0, F.transform(done, placed)).otherwise(F.array().cast("array<double>"))
    return parts.select(
        key, source, "text_hash", "first", "rows", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))


def range_sorted(rows: DataFrame, position: F.Column, ties: list[F.Column]) -> DataFrame:
    """The rows in order of training position, in as many ranges as the session shuffles into."""
    marked = rows.withColumn("__position", position)
    order = [F.col("__position").asc_nulls_last(), *ties]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("__position")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix in training order: every row once per copy, documents not taken left out."""
    planned = keep(plan(docs, key, source, text), "plan").select(
        F.col(key).alias("__key"), F.col(source).alias("__source"), F.col("text_hash").alias("__hash"),
        F.col("first").alias("__first"), F.col("rows").alias("__rows"), F.col("positions").alias("__positions"))
    names = ["__key", "__source", "__hash"]
    # At most one document of a source is in two parts; only its rows are numbered.
    cut = keep(planned.filter("__first > 0").select(*names, F.col("__first").alias("__ends")), "cut-documents")
    here = F.col(key).eqNullSafe(F.col("__key")) & F.col(source).eqNullSafe(F.col("__source")) & (
        F.xxhash64(text) == F.col("__hash"))
    is_cut = [F.col(n).eqNullSafe(F.col(f"__of{n}")) for n in names]
    ends = cut.select(*[F.col(n).alias(f"__of{n}") for n in names], "__ends")
    parts = planned.join(ends, is_cut, "left")
    whole = parts.filter(F.col("__ends").isNull() & (F.size("__positions") > 0))
    rows = keep(docs.join(cut, here).withColumn("__row", F.monotonically_increasing_id()), "cut-rows")
    placed = rows.withColumns({"__spread": F.xxhash64("__row"), "__one": F.lit(1).cast("long")})
    numbered = totals_before(keep(placed, "spread-rows"), names, "__spread", ["__row"], "__one", "__number")
    of_part = (F.col("__number") >= F.col("__ends")) == (F.col("__of_first") > 0)
    halves = parts.filter(F.col("__ends").isNotNull()).select(
        *[F.col(n).alias(f"__of{n}") for n in names], F.col("__first").alias("__of_first"), "__positions")
    again = numbered.join(halves, [*is_cut, of_part])
    copies = docs.join(whole, here).select(*docs.columns, "__positions").union(again.select(*docs.columns, "__positions"))
    copies = copies.withColumn("__at", F.explode("__positions"))
    return range_sorted(copies.select(*docs.columns, "__at"), F.col("__at"), [F.col(key)]).select(*docs.columns)
