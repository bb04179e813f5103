"""Kafka-shaped key/value streams. The connector comes with the cluster; the
same projections work on any table with ``key`` and ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.changes import parse_changes


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic from its earliest record, as texts."""
    records = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest").load()
    )
    return key_values(records)


def key_values(records: DataFrame) -> DataFrame:
    """Key and value as texts, with the record's place in the topic."""
    return records.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")


def json_records(records: DataFrame, key_ddl: str, value_ddl: str) -> DataFrame:
    """Key and value parsed from JSON."""
    return records.select(
        F.from_json(F.col("key").cast("string"), key_ddl).alias("key"),
        F.from_json(F.col("value").cast("string"), value_ddl).alias("value"))


def change_stream(spark: SparkSession, servers: str, topic: str, row_ddl: str) -> DataFrame:
    """Change events of one table, as the change-capture connector publishes them."""
    return parse_changes(topic_stream(spark, servers, topic), row_ddl)
