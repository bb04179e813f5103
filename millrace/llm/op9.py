"""op9: the ten nearest of every hundredth vector among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import hilbert
from millrace.llm.registry import query, table


@query("op9_nearest")
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
