"""Rate limits, facts as of a time, stable ids, marker tables and keyed state, against plain versions."""

import datetime
import random

from pyspark.sql import functions as F

from millrace.operators import ordered, prices, topics, windows
from millrace.sinks import dimension, keyed, output
from millrace.sources import files
from millrace.streaming import run, state


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def through(rows, interval):
    """rows of (key, ms, id), one after another."""
    kept, last = [], {}
    for key, ms, name in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ms >= last[key] + interval:
            last[key] = ms
            kept.append((key, name))
    return sorted(kept, key=str)


def test_rate_limit_with_a_hot_key_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(0, 20_000, 10), i) for i in range(1500)]
    rows += [(None, ms, 5000 + ms) for ms in (0, 99, 100, 100, 199, 200)] + [("one", 7, 9000)]
    frame = spark.createDataFrame([(k, at(ms), i) for k, ms, i in rows] + [("hot", None, 1)], "k string, t timestamp, i long")
    for interval in (100, 5000):
        got = windows.let_through(frame.repartition(6), ["k"], "t", interval, ["i"]).collect()
        assert sorted(((r.k, r.i) for r in got), key=str) == through(rows, interval)
    alone = windows.let_through(frame.select("t", "i"), [], "t", 100, ["i"]).collect()
    assert sorted(r.i for r in alone) == sorted(i for _, i in through([(0, ms, i) for _, ms, i in rows], 100))
    assert windows.let_through(frame.limit(0), ["k"], "t", 100, ["i"]).count() == 0


def test_a_limit_is_counted_from_the_last_row_let_through(spark):
    frame = spark.createDataFrame([(at(ms), ms) for ms in (0, 400, 600, 900, 1100, 1200)], "t timestamp, i long")
    assert sorted(r.i for r in windows.let_through(frame, [], "t", 500, ["i"]).collect()) == [0, 600, 1100]


def test_facts_as_of_a_time(spark):
    rng = random.Random(6)
    facts = [("hot" if i % 2 else f"k{i % 5}", rng.randrange(1000), i) for i in range(800)] + [(None, 1, 1), ("hot", None, 2)]
    asked = [("hot" if i % 2 else f"k{i % 6}", rng.randrange(-50, 1000), i) for i in range(900)] + [(None, 5, 901), ("hot", None, 902)]
    left = spark.createDataFrame(asked, "k string, t long, i long").repartition(5)
    right = spark.createDataFrame(facts, "k string, since long, fact long")

    def last(k, t):
        known = [(s, f) for q, s, f in facts if q == k is not None and s is not None and t is not None and s <= t]
        return max(known)[1] if known else None

    got = ordered.as_of(left, right, ["k"], "t", "since", ["fact"])
    assert got.columns == ["k", "t", "i", "fact"]
    assert sorted((r.i, r.fact) for r in got.collect()) == [(i, last(k, t)) for k, t, i in sorted(asked, key=lambda r: r[2])]
    assert [r.fact for r in ordered.as_of(left, right.limit(0), ["k"], "t", "since", ["fact"]).distinct().collect()][:1] == [None]


def test_ids_stay_as_names_come(spark, tmp_path):
    path, write = f"{tmp_path}/ids", dimension.find_or_create(f"{tmp_path}/ids", "horse")
    batches = [["Bo", "Al", "Bo", None], ["Cy", "Al"], [], ["Aa", "Cy", "Bo "]]
    seen = {}
    for i, names in enumerate(batches):
        frame = spark.createDataFrame([(n,) for n in names], "horse string")
        write(frame, i)
        write(frame, i)  # a batch that is done again changes nothing
        now = {r.name: r.id for r in dimension.read(spark, path).collect()}
        assert now.items() >= seen.items()
        seen = now
    assert seen == {"Al": 1, "Bo": 2, "Cy": 3, "Aa": 4, "Bo ": 5}
    rows = spark.createDataFrame([("Bo", 1), ("Zz", 2), (None, 3)], "horse string, x int")
    assert {r.x: r.id for r in dimension.resolve(rows, path, "horse").collect()} == {1: 2, 2: None, 3: None}
    assert dimension.resolve(rows, f"{tmp_path}/none", "horse").where("id IS NOT NULL").count() == 0


def test_markers_of_a_table_equal_contains(spark):
    words = ["he", "she", "hers", "His", "", None, "é", "x y", "aaa", "aa", "she"]
    lines = ["ushers", "SHE is HIS", None, "", "É x Y", "aaaa", "nothing", "s" * 5000 + "hers"]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, body string")
    markers = spark.createDataFrame([(w,) for w in words], "w string")
    expected = sorted({(i, w.lower()) for i, t in enumerate(lines) if t for w in words if w and w.lower() in t.lower()})
    for block in (3, 1000):
        got = topics.contained(texts, "id", "body", markers, "w", block).collect()
        assert sorted((r.id, r.marker) for r in got) == expected
    assert topics.contained(texts, "id", "body", markers.limit(0), "w").count() == 0


def test_files_do_not_grow_with_the_windows(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 1500).alias("second"), F.concat(F.lit("a\tb"), "id").alias("line"))
    for shards, folder in ((None, "free"), (1, "one")):
        output.windowed_line_files(f"{tmp_path}/{folder}", "line", F.col("second"), shards)(rows, 0)
        found = spark.read.format("binaryFile").load(f"{tmp_path}/{folder}/batch=0").count()
        assert found <= (shards or 8)
        back = output.read_windowed_lines(spark, f"{tmp_path}/{folder}").select(F.col("window").cast("long").alias("second"), "line")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_notices_from_state_equal_those_of_the_table(spark, tmp_path):
    slices = [[(1, "Au", "5"), (3, "Ag", "7"), (2, "Ag", "8"), (2, "Ag", "6")], [(4, "Au", "5"), (5, None, "1")], [(6, None, None), (7, "Pt", "2")]]
    lines = []
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, "n long, k string, v string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = files.table_stream(spark, f"{tmp_path}/in", "*.parquet")
        run.run_through(state.notices(stream, "t", "k", "v", "n"), keyed.append_batch(f"{tmp_path}/out"), f"{tmp_path}/cp")
        lines += rows
    table = spark.createDataFrame(lines, "n long, k string, v string")
    expected = sorted(r.line for r in prices.change_notices(table, "t", "k", "v", "n").collect())
    assert sorted(r.line for r in keyed.read_batches(spark, f"{tmp_path}/out").collect()) == expected


def test_panes_fire_again_with_what_is_new_and_go_on_after_a_stop(spark, tmp_path):
    batches, landed = {}, 0

    def keep(batch, batch_id):  # a batch that is done again replaces itself
        batches[batch_id] = [(r.k, r.firing, r.rows, r.total) for r in batch.collect()]

    def fired():
        return [r for rows in batches.values() for r in rows]

    for part in range(3):
        rows = [("a", 1.0)] * 3 + ([("b", 2.0)] if part == 1 else []) + [(None, None)]
        spark.createDataFrame(rows, "k string, v double").write.mode("append").parquet(f"{tmp_path}/in")
        landed += len(rows)
        stream = files.table_stream(spark, f"{tmp_path}/in", "*.parquet")
        query = run.start(state.early_panes(stream, ["k"], "v", 100), keep, f"{tmp_path}/cp", every="100 milliseconds")
        while sum(r[2] for r in fired()) < landed and not query.awaitTermination(0.1):
            pass
        query.stop()  # the next round goes on from the checkpoint
    out = fired()
    assert sum(r[2] for r in out) == landed
    assert sorted((f, n, t) for k, f, n, t in out if k == "a") == [(0, 3, 3.0), (1, 3, 3.0), (2, 3, 3.0)]
    assert [r for r in out if r[0] == "b"] == [("b", 0, 1, 2.0)]
    assert [(f, n) for k, f, n, _ in sorted(out, key=lambda r: r[1]) if k is None] == [(0, 1), (1, 1), (2, 1)]
