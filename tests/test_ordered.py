"""Total-order work against plain Python, with one hot key and tiny chunks."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import lookup, ordered


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    keys = ["hot"] * 400 + [f"k{i % 37}" for i in range(300)] + [None] * 20
    draw.shuffle(keys)
    return [(key, i, draw.randint(0, 50)) for i, key in enumerate(keys)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, value long").repartition(5)


def by_key(rows):
    groups = {}
    for key, i, value in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(key, []).append((i, value))
    return groups


def test_row_numbers_are_dense_and_in_order(frame, rows):
    numbered = ordered.number_rows(frame, [F.desc("value"), "id"]).collect()
    expected = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [(r.id, r.row_number) for r in sorted(numbered, key=lambda r: r.row_number)] == [
        (row[1], n) for n, row in enumerate(expected, 1)]


def test_row_numbers_of_nothing(frame):
    assert ordered.number_rows(frame.where("id < 0"), ["id"]).count() == 0


@pytest.mark.parametrize("chunk_rows", [1, 7, 10_000])
def test_previous_row_across_chunks(frame, rows, chunk_rows):
    found = ordered.with_previous(frame, ["key"], ["id"], ["value"], chunk_rows).collect()
    expected = {}
    for group in by_key(rows).values():
        for at, (i, _) in enumerate(group):
            expected[i] = group[at - 1][1] if at else None
    assert {r.id: r.previous_value for r in found} == expected


@pytest.mark.parametrize("chunk_rows", [1, 13, 10_000])
def test_moving_average_across_chunks(frame, rows, chunk_rows):
    found = ordered.moving_average(frame, ["key"], ["id"], "value", 5, chunk_rows=chunk_rows).collect()
    expected = {}
    for group in by_key(rows).values():
        for at, (i, _) in enumerate(group):
            window = [v for _, v in group[max(0, at - 4):at + 1]]
            expected[i] = sum(window) / len(window)
    assert {r.id: pytest.approx(r.moving_avg) for r in found} == expected


@pytest.mark.parametrize("parts", [1, 4, 90])
def test_running_total_across_partitions(spark, frame, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = ordered.running_total(frame, ["key"], ["id"], "value").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {}
    for group in by_key(rows).values():
        upto = 0
        for i, value in group:
            upto += value
            expected[i] = (upto, sum(v for _, v in group), len(group))
    assert {r.id: (r.running, r.total, r.members) for r in found} == expected


@pytest.mark.parametrize("capacity", [1, 50, 719, 720, 10_001])
@pytest.mark.parametrize("order", [["id"], ["value", "id"]])
def test_newest_is_exact(frame, rows, capacity, order):
    kept = ordered.newest(frame, order, capacity).collect()
    latest = sorted(rows, key=(lambda r: r[1]) if order == ["id"] else (lambda r: (r[2], r[1])), reverse=True)
    assert {r.id for r in kept} == {r[1] for r in latest[:capacity]} and len(kept) == min(capacity, len(rows))


def test_newest_with_few_extremes(spark):
    values = [0.0] * 300 + [1e12, -1e12, 1e-9, float("inf")][:3] + [None] * 5
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    for capacity in (1, 2, 3, 250, 303, 306):
        kept = ordered.newest(frame, ["v", "id"], capacity).collect()
        known = sorted(((v is not None, v if v is not None else 0.0, i) for i, v in enumerate(values)), reverse=True)
        assert {r.id for r in kept} == {i for _, _, i in known[:capacity]}


@pytest.mark.parametrize("page_rows", [10, 100_000])
def test_lists_come_in_ordered_pages(spark, frame, rows, page_rows):
    lists = lookup.group_lists(frame, "key", "id", "ids", page_rows).collect()
    expected = {key: [i for i, _ in group] for key, group in by_key(rows).items()}
    for key, ids in expected.items():
        pages = sorted((r for r in lists if r.key == key), key=lambda r: r.page)
        assert [r.page for r in pages] == list(range(len(pages)))
        assert [len(r.ids) for r in pages[:-1]] == [page_rows] * (len(pages) - 1) and len(pages[-1].ids) <= page_rows
        assert [i for r in pages for i in r.ids] == ids and {r["size"] for r in pages} == {len(ids)}


def test_equal_items_fill_pages_too(spark):
    frame = spark.createDataFrame([("k", 7)] * 25, "key string, item long")
    pages = lookup.group_lists(frame, "key", "item", "items", 10).orderBy("page").collect()
    assert [len(r["items"]) for r in pages] == [10, 10, 5]
