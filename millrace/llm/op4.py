"""op4: a quality score for every document, learned outside the held-out quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classifier
from millrace.llm.registry import query, table

#: Score from which a document counts as good.
GOOD = 0.7


def held_out(key: str = "doc_id") -> F.Column:
    """The quarter of the ids whose labels are never seen; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def forest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> classifier.Forest:
    """Trees learned from the labels outside the held-out quarter."""
    return classifier.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, forest(spark, docs, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
