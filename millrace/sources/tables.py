"""Shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name. Zone-free timestamps become UTC timestamps, which
    watermarks need."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return with_utc_time(table)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the documents."""
    return load(spark, folder, "documents").select("doc_id", "text")


def with_utc_time(table: DataFrame) -> DataFrame:
    columns = [
        F.col(field.name).cast("timestamp").alias(field.name)
        if field.dataType.typeName() == "timestamp_ntz" else F.col(field.name)
        for field in table.schema.fields
    ]
    return table.select(*columns)
