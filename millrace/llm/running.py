"""Running totals within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task orders, about.
PART_ROWS = 4_000


def digest(key: str) -> F.Column:
    """Hex digits of the hashed key; a null key is hashed as the empty text."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def spread(key: str) -> F.Column:
    """60 bits of the hashed key as the top of a signed number, in the order of the digits."""
    digits = F.conv(F.substring(digest(key), 1, 15), 16, 10).cast("long")
    return F.shiftleft(digits, 4).bitwiseXOR(F.lit(-(2**63)))


def totals_before(
    rows: DataFrame, groups: list[str], spread: str, order: list[str], value: str, out: str, part_rows: int = PART_ROWS,
) -> DataFrame:
    """The rows with ``out``: the sum of ``value`` over the earlier rows of the same group.

    Rows are ordered by ``spread``, a 64-bit hash column, then by ``order``. A group is
    cut into equal ranges of the hash, so that the largest group gives parts of about
    ``part_rows`` rows; each part is ordered alone and starts at the sum of the parts
    before it. Parts depend on the rows only, so the result does not depend on them.
    Equal hashes stay together: they must be few (a hash of a key, not of a group).
    ``rows`` is read three times: pass a table.
    """
    largest = rows.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    bits = max(0, -(-largest // part_rows) - 1).bit_length()
    part = F.shiftright(F.col(spread), 64 - bits) if bits else F.lit(0).cast("long")
    parted = rows.withColumn("__part", part)
    in_order = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(*groups, "__part").agg(F.sum(value).alias("__sum")).select(
        *[F.col(g).alias(f"__{g}") for g in groups], F.col("__part").alias("__of"),
        F.coalesce(F.sum("__sum").over(in_order), F.lit(0)).alias("__start"))
    same = F.col("__part") == F.col("__of")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    within = Window.partitionBy(*groups, "__part").orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    return parted.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, same).withColumn(
        out, F.col("__start") + F.col("__within")).drop(
        "__part", "__of", "__sum", "__start", "__within", *[f"__{g}" for g in groups])
