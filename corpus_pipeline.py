"""The corpus pipeline: documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classifier, line_dedup, mixing, op4, op10, shingles
from millrace.llm.registry import keep, keep_only, query, table

WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good."""
    forest = op4.forest(spark, docs, sf_dir)
    return classifier.score(docs, forest, out="__score").filter(F.col("__score") >= op4.GOOD).select(*docs.columns)


def _narrow(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns in one, so that no name of theirs meets one of a stage."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *rest).alias("__rest"))


def _whole(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns again."""
    return docs.select(*[c if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a text that loses all its words goes."""
    cut = line_dedup.dedup(_narrow(docs))
    left = _whole(cut.filter((F.col("lines_removed") == 0) | F.col("text").rlike(WORD)), docs.columns)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 on five words): that with the smallest id, null ids last.

    Rows equal in id and text are copies too; of them the one whose other columns come first stays.
    """
    parts = {"__a": F.coalesce("doc_id", F.lit(2**63 - 1)), "__b": F.xxhash64("text")}
    named = docs.select(F.struct(*[x.alias(n) for n, x in parts.items()]).alias("__name"), "text")

    def firsts() -> DataFrame:
        groups = shingles.near_groups(named, key="__name")
        return groups.filter(F.col("__name") == F.col("component_id")).select("__name.__a", "__name.__b").distinct()

    first = keep_only(firsts, "kept")
    kept = _narrow(docs).withColumns(parts).join(first, list(parts), "left_semi").groupBy(*parts).agg(
        F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min_by("__rest", F.to_json("__rest")).alias("__rest"))
    return _whole(kept, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as the target weights ask for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return op10.digests(docs)


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("near dedup", near_copies), ("mixing", mix),
    ("tokens", tokens)]

#: The classifier's trees cannot be said in SQL; the pipeline is tested against its stages done plainly.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
