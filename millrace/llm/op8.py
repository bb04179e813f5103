"""op8: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import simhash
from millrace.llm.registry import query, table


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")
