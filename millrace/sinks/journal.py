"""A journal of changes that holds the newest ones.

Every batch is a segment, with a head that says how many changes lie before it and in it.
A segment is out of date once newer ones hold ``capacity`` changes or more, and goes as a
whole, so the newest ``capacity`` changes are always there. Files of a segment go one batch
after readers stop seeing it, so a read that has begun can end.

A follower's position is the number of changes it has taken. What it asks for from there
is lost only as far as it fell behind the oldest segment, and it is told how much that is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.sinks.keyed import BatchWriter

HEAD = "batch long, start long, rows long"


class Followed(NamedTuple):
    """Changes after a position, the position behind them, and the changes lost before them."""

    changes: DataFrame
    position: int
    lost: int


def _heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD).parquet(f"{path}/heads/*")


def _live(heads: DataFrame, capacity: int) -> DataFrame:
    """Heads with ``live``: whether newer segments hold less than the capacity. There is a row per segment on file."""
    newer = F.sum("rows").over(Window.orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1))
    return heads.withColumn("live", F.coalesce(newer, F.lit(0)) < capacity)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_journal(path: str, capacity: int) -> BatchWriter:
    """Keep the changes of every batch as a segment, and the newest ``capacity`` changes at least.

    A repeated batch replaces its segment and head.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        segment = f"{path}/segments/batch={batch_id}"
        batch.write.mode("overwrite").parquet(segment)
        rows = spark.read.schema(batch.schema).parquet(segment).count()
        try:
            before = _heads(spark, path).where(F.col("batch") < batch_id)
            start = before.agg(F.max(F.col("start") + F.col("rows"))).first()[0] or 0
        except AnalysisException:  # the first segment
            start = 0
        head = spark.createDataFrame([(batch_id, start, rows)], HEAD)
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/{batch_id}")
        # As of the batch before: what readers have not seen since then.
        old = _live(_heads(spark, path).where(F.col("batch") < batch_id), capacity).where(~F.col("live"))
        for gone in [r["batch"] for r in old.collect()]:  # segments of about one batch
            _remove(spark, f"{path}/segments/batch={gone}")
            _remove(spark, f"{path}/heads/{gone}")  # last, so that a broken-off removal is done again

    return write


def follow(spark: SparkSession, path: str, capacity: int, position: int = 0) -> Followed:
    """The changes after ``position`` that the journal holds, with the ``batch`` each came in."""
    heads = _live(_heads(spark, path), capacity).where("live")
    end = F.col("start") + F.col("rows")
    first, last = heads.agg(F.min("start"), F.max(end)).first()
    ahead = heads.where(end > position).select("batch")
    changes = spark.read.parquet(f"{path}/segments").join(ahead, "batch", "left_semi")
    return Followed(changes, max(last, position), max(0, first - position))
