"""The trend from merged moments against exact fractions."""

import datetime
import random
from fractions import Fraction

import pytest

from millrace.operators import trend

BASE = datetime.datetime(2016, 3, 1)


def exact(points):
    xs, ys = [Fraction(x) for x, _ in points], [Fraction(y) for _, y in points]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    xx = sum((x - mx) ** 2 for x in xs)
    return float(sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / xx) if xx else None


@pytest.mark.parametrize("size,slide", [(120, 15), (50, 20), (10, 30)])
def test_slopes_equal_exact_ones(spark, size, slide):
    rand = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 4}", BASE + datetime.timedelta(milliseconds=rand.randrange(86_400_000)), rand.randrange(1000))
            for i in range(600)] + [("one", BASE, 5), ("one", BASE, 7), ("none", None, 1), ("none", BASE, None)]
    points = {}
    for key, time, count in rows:
        if time is None or count is None:
            continue
        ms = (time - BASE) // datetime.timedelta(milliseconds=1)
        for k in range((ms - size * 60_000) // (slide * 60_000) + 1, ms // (slide * 60_000) + 1):
            points.setdefault((key, k * slide + size), []).append((ms, count))
    frame = spark.createDataFrame(rows, "location string, time timestamp, count int")
    found = {(r.location, (r.window_end - BASE) // datetime.timedelta(minutes=1)): r.slope
             for r in trend.linear_trend(frame, f"{size} minutes", f"{slide} minutes").collect()}
    assert set(found) == set(points)
    for name, rows_of in points.items():
        slope = exact(rows_of)
        assert found[name] is None if slope is None else found[name] == pytest.approx(slope, rel=1e-8, abs=1e-12)
