"""Streams: late rows, several batches, repeated batches, batch equals stream."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes, gps, trend, windows
from millrace.sinks import keyed, output
from millrace.sources import files
from millrace.streaming import numbering, run
from millrace.streaming import windows as stream_windows


def land(spark, folder, batches, ddl):
    """One Parquet file per batch, stamped so that they are read in order."""
    for number, rows in enumerate(batches):
        part = f"{folder}/part-{number}"
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.utime(f"{part}/{name}", (1_700_000_000 + number, 1_700_000_000 + number))
    schema = spark.createDataFrame([], ddl).schema
    return (spark.readStream.schema(schema).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1).parquet(folder))


def at(seconds):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_late_rows_are_dropped_and_the_rest_comes_once(spark, tmp_path):
    batches = [[(1, at(10.0))], [(2, at(20.0)), (3, at(19.5)), (4, at(9.5))], [(6, at(21.0))],
               [(5, at(12.0)), (8, at(30.0))], [(7, at(5.0)), (9, at(31.0))]]
    stream = land(spark, f"{tmp_path}/in", batches, "id long, ts timestamp")
    rows = stream_windows.in_time_rows(stream, "id", "ts")
    run.run_through(rows, keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/cp")
    out = keyed.read_batches(spark, f"{tmp_path}/out").select("id", "window.start").collect()
    ids = sorted(r.id for r in out)
    # Lateness is judged by the watermark of the batch before: 19 s for row 5.
    assert ids == [1, 2, 3, 4, 6, 8, 9]
    assert {r.id: str(r.start) for r in out}[3] == "2024-01-01 00:00:19"


def test_watermarked_panes_equal_the_batch_for_closed_windows(spark, tmp_path):
    batches = [[("a", at(i + 0.05 * b), float(i * b)) for i in range(b * 5, b * 5 + 5)] for b in range(4)]
    stream = land(spark, f"{tmp_path}/in", batches, "k string, ts timestamp, v double")
    panes = stream_windows.pane_stream(stream, "k", "ts", "v", 200)
    run.run_through(panes, keyed.append_batch(f"{tmp_path}/panes"), f"{tmp_path}/cp")
    stored = keyed.read_batches(spark, f"{tmp_path}/panes").drop("batch")
    streamed = windows.unfold_segments(windows.segments_of_panes(stored, "k", 3000, 200), 200)
    whole = spark.createDataFrame([r for b in batches for r in b], "k string, ts timestamp, v double")
    whole = whole.withColumn("ms", F.unix_millis("ts")).where(F.col("ts") < F.lit(at(18.15)))
    batch = windows.unfold_segments(windows.sliding_segments(whole, "k", "ms", "v", 3000, 200), 200)

    def plain(frame):
        return sorted((r.k, r.window_end, round(r.avg, 9), r["count"]) for r in frame.collect())

    assert plain(streamed) == plain(batch)


def test_trend_stream_equals_batch_for_closed_windows(spark, tmp_path):
    rows = [("x", at(900 * i), (7 * i) % 11) for i in range(80)]
    stream = land(spark, f"{tmp_path}/in", [rows[:30], rows[30:60], rows[60:]], "location string, time timestamp, count int")
    keys = ["location", "window_end"]
    run.run_through(stream_windows.trend_stream(stream), keyed.upsert(f"{tmp_path}/t", keys, keys), f"{tmp_path}/cp")
    streamed = keyed.read_latest(spark, f"{tmp_path}/t", keys, [])
    whole = trend.linear_trend(spark.createDataFrame(rows, "location string, time timestamp, count int"))
    closed = whole.where(F.col("window_end") <= F.lit(at(900 * 79 - 300 * 60)))

    def plain(frame):
        return {(r.location, r.window_end): r.slope and round(r.slope * 1e6, 9) for r in frame.collect()}

    assert plain(streamed) == plain(closed)


def test_late_count_is_dropped_past_300_minutes(spark, tmp_path):
    batches = [[("x", at(0), 1)], [("x", at(86_400), 1)], [("x", at(87_300), 1)],
               [("x", at(900), 50)], [("x", at(90_000), 1)]]
    stream = land(spark, f"{tmp_path}/in", batches, "location string, time timestamp, count int")
    run.run_through(stream_windows.trend_stream(stream), keyed.append_batch(f"{tmp_path}/t"), f"{tmp_path}/cp")
    slopes = [r.slope for r in keyed.read_batches(spark, f"{tmp_path}/t").collect()]
    assert slopes and all(s in (None, 0.0) for s in slopes)  # the 50 at 900 s never joined the 1 at 0


def test_upsert_over_batches_and_repeats(spark, tmp_path):
    path = f"{tmp_path}/table"
    write = keyed.upsert(path, ["k"], ["ord"])
    first = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, ord long, v string")
    late = spark.createDataFrame([("a", 2, "old"), ("b", 5, "new")], "k string, ord long, v string")
    write(first, 0)
    write(late, 1)
    write(late, 1)  # the same batch again after a failure
    assert spark.read.parquet(f"{path}/batches").count() == 4
    assert {r.k: r.v for r in keyed.read_latest(spark, path, ["k"], ["ord"]).collect()} == {"a": "y", "b": "new"}


def test_batches_go_on_after_compaction(spark, tmp_path):
    path = f"{tmp_path}/table"
    write = keyed.upsert(path, ["k"], ["ord"])

    def batch(*rows):
        return spark.createDataFrame(rows, "k string, ord long, v string")

    def latest():
        return {r.k: r.v for r in keyed.read_latest(spark, path, ["k"], ["ord"]).collect()}

    write(batch(("a", 1, "a1"), ("b", 1, "b1")), 0)
    keyed.compact(spark, path, ["k"], ["ord"])
    keyed.compact(spark, path, ["k"], ["ord"])  # nothing new
    assert latest() == {"a": "a1", "b": "b1"}
    write(batch(("a", 1, "a1"), ("b", 1, "b1")), 0)  # the compacted batch again after a failure
    write(batch(("c", 1, "c1"), ("b", 2, "b2")), 1)
    assert latest() == {"a": "a1", "b": "b2", "c": "c1"}
    write(batch(("a", 0, "old")), 2)
    keyed.compact(spark, path, ["k"], ["ord"])
    write(batch(("a", 9, "a9")), 3)
    assert latest() == {"a": "a9", "b": "b2", "c": "c1"}


def test_a_repeated_batch_reaches_followers_once(spark, tmp_path):
    import shutil
    stream = land(spark, f"{tmp_path}/in", [[(1,), (2,)], [(3,)]], "id long")
    keyed.write_journal(stream, f"{tmp_path}/journal", f"{tmp_path}/cp").awaitTermination()

    def follow():
        run.run_through(keyed.journal_stream(spark, f"{tmp_path}/journal"), keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/follow")
        return sorted(r.id for r in keyed.read_batches(spark, f"{tmp_path}/out").collect())

    assert follow() == [1, 2, 3]
    # As after a failure between writing a batch and noting it: the last commit is gone, the batch comes again.
    commits = sorted(os.listdir(f"{tmp_path}/cp/commits"))
    for name in [c for c in commits if c.lstrip(".").startswith("1")]:
        shutil.move(f"{tmp_path}/cp/commits/{name}", f"{tmp_path}/moved-{name.lstrip('.')}")
    keyed.write_journal(stream, f"{tmp_path}/journal", f"{tmp_path}/cp").awaitTermination()
    assert follow() == [1, 2, 3]


def test_numbers_run_on_over_batches(spark, tmp_path):
    batches = [[(i,) for i in range(b * 10, b * 10 + 10)] for b in range(3)]
    stream = land(spark, f"{tmp_path}/in", batches, "id long")
    writer = numbering.numbered(keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/n", ["id"], "number")
    run.run_through(stream, writer, f"{tmp_path}/cp")
    out = keyed.read_batches(spark, f"{tmp_path}/out").collect()
    assert sorted((r.id, r.number) for r in out) == [(i, i + 1) for i in range(30)]


def test_changes_materialise_over_batches(spark, tmp_path):
    def value(op, pos, name):
        row = f'{{"id":1,"first_name":"{name}"}}'
        side = "before" if op == "d" else "after"
        return f'{{"payload":{{"{side}":{row},"source":{{"file":"b.1","pos":{pos},"row":0}},"op":"{op}"}}}}'

    for steps, expected in [([("c", 1, "A"), ("u", 2, "B")], ["B"]), ([("c", 1, "A"), ("d", 2, "A")], [])]:
        place = f"{tmp_path}/{len(expected)}"
        stream = land(spark, f"{place}/in", [[("1", value(*s))] for s in steps] + [[("1", None)]], "key string, value string")
        run.run_through(changes.parse_changes(stream), keyed.upsert(f"{place}/log", ["key"], changes.ORDER), f"{place}/cp")
        latest = keyed.read_latest(spark, f"{place}/log", ["key"], changes.ORDER)
        assert [r.first_name for r in changes.current_rows(latest).collect()] == expected


def test_fan_out_computes_a_batch_for_all_writers(spark, tmp_path):
    points = spark.createDataFrame([(1, "1", "2", 0), (2, "1", "2", 9000)], "input_point long, lat string, lon string, offset long")
    lines = gps.point_json(gps.replay(points, 0))
    start = F.window(F.timestamp_millis("replay_ms"), "1 second")["start"]
    output.fan_out(output.line_files(f"{tmp_path}/plain", "line", shards=1),
                   output.windowed_line_files(f"{tmp_path}/windowed", "line", start))(lines, 0)
    assert spark.read.text(f"{tmp_path}/plain").select("value").count() == 2
    rows = output.read_windowed_lines(spark, f"{tmp_path}/windowed").select("window", "line").collect()
    assert {r.window for r in rows} == {"1970-01-01 00:00:00", "1970-01-01 00:00:09"}
    assert sorted(r.line for r in rows) == sorted(r.line for r in lines.select("line").collect())


def test_publish_sends_each_line_once(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import uuid
        return f"{folder}/{uuid.uuid4().hex}"

    def send(path, line):
        with open(path, "a") as topic:
            topic.write(line + "\n")

    output.publish(spark.range(20).select(F.col("id").cast("string").alias("line")).repartition(4), connect, send, "line")
    sent = [line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split()]
    assert sorted(sent, key=int) == [str(i) for i in range(20)]


def test_peek_counts_rows_in_passing(spark):
    from pyspark.sql import Observation
    seen = Observation("seen")
    spark.range(7).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get["rows"] == 7
    assert output.peek(spark.range(7), "named").count() == 7


def test_tracked_posts_and_line_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "posts.txt").write_text('{"text":"#BTC up"}\n{"text":"rain"}\n')
    posts = files.tracked_posts(files.line_stream(spark, f"{tmp_path}/in", "*.txt", 1))
    run.run_through(posts, keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert [r.text for r in keyed.read_batches(spark, f"{tmp_path}/out").collect()] == ["#BTC up"]


def test_ingestion_time_is_one_instant_per_batch(spark):
    assert stream_windows.stamped_now(spark.range(5)).select("ingested").distinct().count() == 1


def test_processing_time_trigger(spark, tmp_path):
    stream = land(spark, f"{tmp_path}/in", [[(1,)], [(2,)]], "id long")
    query = run.start(stream, keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/cp", every="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((r.id, r.batch) for r in keyed.read_batches(spark, f"{tmp_path}/out").collect()) == [(1, 0), (2, 1)]


def test_journal_is_followed_from_its_oldest_change(spark, tmp_path):
    write = keyed.append_batch(f"{tmp_path}/journal")
    write(spark.createDataFrame([("a", 1)], "k string, v long"), 0)
    write(spark.createDataFrame([("a", 2)], "k string, v long"), 1)
    run.run_through(keyed.journal_stream(spark, f"{tmp_path}/journal"), keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
