"""What a query writes, moves and holds beside its results."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.operators import lookup, scoring, windows, wordchain
from millrace.plans import betting, scoring as plan

SMALL = "/root/testdata/sf0.001"


def test_user_records_are_written_packed_in_short_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(betting.session, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(betting, "USERS_PER_FILE", 1000, raising=False)
    users = betting.users(spark, SMALL)
    lines = spark.read.text(f"{tmp_path}/users")
    chars = lines.selectExpr("sum(length(value))").first()[0]
    parts = glob.glob(f"{tmp_path}/users/part-*")
    assert users.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert sum(map(os.path.getsize, parts)) < chars / 3
    assert len(parts) == -(-users.count() // 1000)


def accumulated(frame):
    """The rows, and a count that each of them adds one to when it passes."""
    count = frame.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(run, frame.schema), count


def test_only_labelled_texts_are_encoded_and_each_once(spark, monkeypatch):
    """The texts that a text model meets: once for the dictionary, then those with a label."""
    read = []
    plain = scoring.encode_reviews

    def counted(frame, text, dictionary):
        known, count = accumulated(frame)
        read.append(count)
        return plain(known, text, dictionary)

    monkeypatch.setattr(scoring, "encode_reviews", counted)
    plans.QUERIES["text_embedding"](spark, SMALL).collect()
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    with_label = documents.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").count()
    # Whole tables pass for training and for the held-out rows: a filter cannot go below this counter.
    assert sum(c.value for c in read) <= 2 * with_label < 2 * documents.count()


def test_measures_of_texts_are_written_once(spark, monkeypatch):
    met = []
    plain = plan.labelled

    def counted(spark_, folder):
        rows, count = accumulated(plain(spark_, folder))
        met.append(count)
        return rows

    monkeypatch.setattr(plan, "labelled", counted)
    found = plans.QUERIES["gbt_match"](spark, SMALL).collect()
    assert found and sum(c.value for c in met) == plain(spark, SMALL).count()


def test_a_step_of_the_walks_has_the_tasks_its_rows_need(spark):
    """Not those of a shuffle: thirteen steps of hundreds of tasks each cost more than the walks."""
    table = wordchain.transitions(spark.createDataFrame([(".", "a", 2), ("a", "b", 1), ("b", ".", 1), ("a", "c", 3)], "word string, next_word string, count long"))
    walks = spark.range(50).withColumnRenamed("id", "doc_id")
    texts = sorted(tuple(r) for r in wordchain.random_walks(table, walks, "doc_id", 4).collect())
    tracker, group = spark.sparkContext.statusTracker(), "steps"
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        spark.sparkContext.setJobGroup(group, group)
        again = sorted(tuple(r) for r in wordchain.random_walks(table, walks, "doc_id", 4).collect())
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert again == texts and len(texts) == 50
    # The last stage reads the words of all five steps.
    assert tasks and max(tasks) <= 5 * spark.sparkContext.defaultParallelism


@pytest.fixture
def one_partition(spark, monkeypatch):
    """A session whose shuffles have one partition, and tasks of 300 rows."""
    monkeypatch.setattr(lookup, "TASK_ROWS", 300, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def largest(frame):
    return max(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


def test_odds_are_grouped_in_partitions_of_bounded_size(one_partition):
    latest = plans.QUERIES["odds_latest"](one_partition, SMALL).persist()
    assert latest.count() > 1500
    assert largest(latest) < 600


def test_marks_of_windows_are_sorted_in_partitions_of_bounded_size(one_partition):
    events = one_partition.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 10_000).alias("ms"), F.lit(1.0).alias("v"))
    segments = windows.sliding_segments(events, "k", "ms", "v", 30_000, 200).persist()
    assert segments.count() > 1500
    assert largest(segments) < 900
