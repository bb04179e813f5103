"""Sliding windows from panes against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import windows


def brute_force(rows, size, slide):
    sums = {}
    for key, at, value in rows:
        pane = at // slide
        for end in range(pane + 1, pane + size // slide + 1):
            sums.setdefault((key, end * slide), []).append(value)
    return {k: (pytest.approx(sum(v) / len(v)), len(v)) for k, v in sums.items()}


@pytest.mark.parametrize("size,slide", [(3000, 200), (400, 200), (1000, 1000), (5000, 100), (60_000, 500)])
def test_segments_unfold_to_every_window(spark, size, slide):
    draw = random.Random(size)
    rows = [(draw.choice("aab"), draw.randint(-4000, 60_000), draw.random()) for _ in range(150)]
    frame = spark.createDataFrame(rows, "k string, ms long, v double").repartition(3)
    segments = windows.sliding_segments(frame, "k", "ms", "v", size, slide)
    found = windows.unfold_segments(segments, slide).collect()
    assert len(found) == len({(r.k, r.window_end) for r in found})
    assert {(r.k, r.window_end): (r.avg, r["count"]) for r in found} == brute_force(rows, size, slide)


def test_same_as_the_built_in_window(spark):
    rows = [("a", 1000 * i + 37 * (i % 7), float(i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "k string, ms long, v double")
    built_in = (
        frame.groupBy("k", F.window(F.timestamp_millis("ms"), "30 seconds", "200 milliseconds"))
        .agg(F.avg("v").alias("avg"), F.count("*").alias("count"))
        .select("k", F.round("avg", 9), "count", F.unix_millis("window.end")))
    segments = windows.sliding_segments(frame, "k", "ms", "v", 30_000, 200)
    ours = windows.unfold_segments(segments, 200).select("k", F.round("avg", 9), "count", "window_end")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, built_in.collect()))


def test_latest_window_holds_only_the_last_pane(spark):
    frame = spark.createDataFrame([("a", 0, 1.0), ("a", 150, 3.0), ("a", 900, 5.0)], "k string, ms long, v double")
    panes = windows.pane_sums(frame, "k", "ms", "v", 200)
    last = windows.latest_windows(panes, "k", {"s": 1000}, 200).first()
    assert (last.window, last.window_end, last.avg, last["count"]) == ("s", 1800, 5.0, 1)


@pytest.mark.parametrize("as_of", [None, 20_000, 30_050, 41_000, 70_000])
def test_latest_windows_are_the_last_of_all_windows(spark, as_of):
    draw = random.Random(5)
    rows = [(draw.choice("abc"), draw.randint(0, 40_000), draw.random()) for _ in range(120)]
    rows.append(("late", 39_990, 1.0))
    rows.append(("early", 10, 2.0))
    frame = spark.createDataFrame(rows, "k string, ms long, v double")
    panes = windows.pane_sums(frame, "k", "ms", "v", 200)
    sizes = {"short": 3000, "long": 12_000}
    found = windows.latest_windows(panes, "k", sizes, 200, as_of).collect()
    for name, size in sizes.items():
        last = {}
        for (key, end), result in brute_force(rows, size, 200).items():
            if as_of is None or end <= as_of:
                last[key] = max(last.get(key, (0,)), (end, result), key=lambda item: item[0])
        assert {r.k: (r.window_end, (r.avg, r["count"])) for r in found if r.window == name} == last


def test_slide_must_divide_the_size(spark):
    frame = spark.createDataFrame([("a", 0, 1.0)], "k string, ms long, v double")
    with pytest.raises(ValueError):
        windows.sliding_segments(frame, "k", "ms", "v", 1000, 300)


def test_best_of_a_tumbling_window_breaks_ties(spark):
    frame = spark.sql("""SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:00:00.1', 'cat', 0.5, 1),
        (TIMESTAMP'2024-01-01 00:00:00.9', 'dog', 0.5, 2), (TIMESTAMP'2024-01-01 00:00:01', 'cow', 0.1, 3) AS t(ts, name, score, tie)""")
    best = windows.tumbling_best(frame, "ts", "1 second", "score", ["tie"], ["name"]).orderBy("window_end").collect()
    assert [r.name for r in best] == ["dog", "cow"]


def test_downsampling_keeps_the_first_row_of_a_slot(spark):
    frame = spark.sql("""SELECT * FROM VALUES ('u', TIMESTAMP'2024-01-01 00:00:00.4', 1),
        ('u', TIMESTAMP'2024-01-01 00:00:00.1', 2), ('u', TIMESTAMP'2024-01-01 00:00:00.5', 3) AS t(u, ts, id)""")
    assert sorted(r.id for r in windows.downsample(frame, ["u"], "ts", "500 milliseconds", ["id"]).collect()) == [2, 3]
