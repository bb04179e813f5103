"""A dimension of names whose ids never change: find a name's id, or create the next one.

The folder keeps ``version=N`` with the names that batch N was the first to bring. New
names are numbered after the highest id of all versions before, in the order of the
names; a repeated batch reads the same versions and replaces its own, so ids hold.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.ordered import number_rows
from millrace.sinks.keyed import BatchWriter

FIRST_ID = 1


def read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(name, id) of all versions, or of those before one; None if there is none yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return None
    return (stored if before is None else stored.where(F.col("version") < before)).select("name", "id")


def find_or_create(path: str, name: str) -> BatchWriter:
    """A writer that gives every new name of a batch an id. Equal names are one; NULL is no name."""

    def write(batch: DataFrame, batch_id: int) -> None:
        names = batch.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
        known = read(batch.sparkSession, path, batch_id)
        highest = FIRST_ID - 1
        if known is not None:
            names = names.join(known.select("name"), "name", "left_anti")
            highest = known.agg(F.coalesce(F.max("id"), F.lit(highest))).first()[0]
        numbered = number_rows(names, ["name"], "place")
        numbered.select("name", (F.col("place") + highest).alias("id")).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def resolve(rows: DataFrame, path: str, name: str, out: str = "id") -> DataFrame:
    """The rows with the id of their name; NULL for a name without one."""
    known = read(rows.sparkSession, path)
    if known is None:
        return rows.withColumn(out, F.lit(None).cast("long"))
    known = known.select(F.col("name").alias("_name"), F.col("id").alias(out))
    return rows.join(known, F.col(name) == F.col("_name"), "left").drop("_name")
