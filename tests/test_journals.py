"""Topics through restarts, journals of bounded size, lookups in keyed tables."""

import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.sinks import journal, keyed, topic
from millrace.sources import files


def land(spark, place, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(f"{place}/in")


def send(spark, place, checkpoint, change=lambda df: df):
    stream = change(files.line_stream(spark, f"{place}/in"))
    topic.write_topic(stream, f"{place}/out", f"{place}/{checkpoint}", "a").awaitTermination()


def lines_of(spark, place):
    return sorted(r["value"] for r in topic.read_topic(spark, f"{place}/out").collect())


def test_a_batch_that_runs_again_adds_no_line(spark, tmp_path):
    """The second checkpoint is that of a driver lost after the topic's commit."""
    place = str(tmp_path)
    land(spark, place, [f"one {i}" for i in range(50)])
    send(spark, place, "c1")
    shutil.copytree(f"{place}/c1", f"{place}/c2")
    land(spark, place, ["two", "two", "", "é"])
    send(spark, place, "c1")
    whole = lines_of(spark, place)
    assert whole == sorted([*(f"one {i}" for i in range(50)), "two", "two", "", "é"])
    send(spark, place, "c2")
    assert lines_of(spark, place) == whole
    land(spark, place, ["three"])
    send(spark, place, "c2")
    assert lines_of(spark, place) == sorted([*whole, "three"])


def test_a_failed_batch_leaves_nothing_and_is_made_up(spark, tmp_path):
    place, marker = str(tmp_path), str(tmp_path / "mended")

    def fail_once(df):
        @F.udf("string")
        def check(value):
            if value == "bad" and not os.path.exists(marker):
                raise RuntimeError("lost")
            return value
        return df.select(check("value").alias("value"))

    land(spark, place, ["a", "b"])
    send(spark, place, "c", fail_once)
    land(spark, place, [*(f"more {i}" for i in range(30)), "bad"])
    with pytest.raises(StreamingQueryException):
        send(spark, place, "c", fail_once)
    assert lines_of(spark, place) == ["a", "b"]
    open(marker, "w").close()
    send(spark, place, "c", fail_once)
    assert lines_of(spark, place) == sorted(["a", "b", "bad", *(f"more {i}" for i in range(30))])


def test_a_journal_holds_its_capacity_and_no_more(spark, tmp_path):
    path, write = str(tmp_path / "j"), journal.bounded_journal(str(tmp_path / "j"), 25)
    position, taken = 0, []
    for batch in range(12):
        rows = spark.range(batch * 10, batch * 10 + 10).withColumnRenamed("id", "change")
        write(rows, batch)
        if batch == 5:
            write(rows, batch)  # a repeated batch changes nothing
        if batch % 2 == 1:  # a follower two batches behind
            found = journal.follow(spark, path, 25, position)
            assert found.lost == 0
            taken += sorted(r["change"] for r in found.changes.collect())
            position = found.position
    assert taken == list(range(120)) and position == 120
    assert journal.follow(spark, path, 25, position).changes.count() == 0
    late = journal.follow(spark, path, 25, 40)
    assert late.lost == 50 and sorted(r["change"] for r in late.changes.collect()) == list(range(90, 120))
    assert len(os.listdir(f"{path}/segments")) <= 5 and len(os.listdir(f"{path}/heads")) <= 5
    write(spark.range(0).withColumnRenamed("id", "change"), 12)
    assert journal.follow(spark, path, 25, 110).changes.count() == 10


def test_a_lookup_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    write = keyed.upsert(path, ["k"], ["at"])
    for batch in range(3):
        write(spark.range(0, 400).select(F.col("id").alias("k"), F.lit(batch).alias("at"), (F.col("id") * batch).alias("v")), batch)
    wanted = spark.createDataFrame([(7,), (7,), (None,), (9999,)], "k long")
    before = keyed.read_keys(spark, path, ["k"], ["at"], wanted)
    assert [tuple(r) for r in before.select("k", "at", "v").collect()] == [(7, 2, 14)]
    keyed.compact(spark, path, ["k"], ["at"], buckets=8)
    write(spark.createDataFrame([(7, 3, 70), (500, 3, 1)], "k long, at int, v long"), 3)
    found = keyed.read_keys(spark, path, ["k"], ["at"], wanted)
    assert [tuple(r) for r in found.select("k", "at", "v").collect()] == [(7, 3, 70)]
    assert len([x for x in os.listdir(f"{path}/bases/upto=2") if x.startswith("bucket=")]) == 8
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    whole = keyed.read_latest(spark, path, ["k"], ["at"])
    assert whole.columns == ["k", "at", "v"] and whole.count() == 401
    assert whole.where("k = 8").first()["v"] == 16
