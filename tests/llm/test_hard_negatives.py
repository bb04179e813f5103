"""Hard negatives: intervals hold the true products, results equal a plain search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as h
from millrace.llm.queries import QUERIES

COLUMNS = "vec_id long, embedding array<float>, label int"


def plainly(rows, anchor, positives=5, negatives=5, share=80):
    """The same by comparing everything; rows of (id, vector, label)."""
    fine = {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows
            if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    sizes = [len(v) for _, _, v in fine]
    usual = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    fine = [r for r in fine if len(r[2]) == usual]
    out = []
    for i, l, v in fine:
        if not anchor(i):
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, m) for j, m, w in fine if j != i)
        for p, j in [(-s, j) for s, j, m in scored if m == l][:positives]:
            hard = [(-s, k) for s, k, m in scored if m != l and share * p <= -100 * s <= 100 * p][:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(hard, 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, COLUMNS)
    return sorted(tuple(r) for r in h.mine(frame, F.col("id") % 5 == 0, **options).collect())


def vectors(n, dimension, seed=1, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dimension))
    labels = rng.integers(0, 3, n)
    points = centres[rng.integers(0, 3, n)] * spread + rng.normal(size=(n, dimension)) * 0.3
    return [(i, [float(np.float32(x)) for x in p], int(l)) for i, (p, l) in enumerate(zip(points, labels))]


@pytest.mark.parametrize("dimension", [1, 3, 64, 100])
def test_results_equal_a_plain_search(spark, dimension):
    rows = vectors(160, dimension, dimension)
    assert found(spark, rows) == plainly(rows, lambda i: i % 5 == 0) != []


def test_blocks_of_anchors_and_more_partners(spark):
    rows = vectors(120, 8)
    expected = plainly(rows, lambda i: i % 5 == 0, 3, 2, 50)
    assert found(spark, rows, block_anchors=7, positives=3, negatives=2, share=50) == expected


def test_one_common_vector_and_ties(spark):
    rows = vectors(60, 4) + [(100 + i, [0.5, 0.5, -0.25, 1.0], i % 2) for i in range(60)]
    assert found(spark, rows) == plainly(rows, lambda i: i % 5 == 0) != []


def test_odd_rows(spark):
    rows = vectors(40, 4)
    rows += rows[:10]  # repeated
    rows += [(5, [0.1, 0.2, 0.3, 0.4], 1), (None, [1.0] * 4, 1), (200, None, 1), (201, [1.0] * 4, None), (202, [], 1),
             (203, [1.0, None, 1.0, 1.0], 1), (204, [1.0, float("nan"), 1.0, 1.0], 1), (205, [float("inf")] * 4, 1),
             (206, [0.0] * 4, 1), (210, [1.0] * 3, 1), (-5, [0.3] * 4, 0)]
    assert found(spark, rows) == plainly(rows, lambda i: i % 5 == 0) != []
    assert found(spark, rows + [(300, [1e30] * 4, 1)]) == found(spark, rows)  # no exact score


def test_none_and_one(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0], 1)]) == []
    assert found(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]) == []  # no anchor


def test_extra_columns_are_not_read(spark):
    rows = vectors(40, 4)
    frame = spark.createDataFrame(rows, COLUMNS).withColumns(
        {n: F.lit("x") for n in ("id", "slot", "score", "vector", "codes", "rank", "wide", "d")})
    assert sorted(tuple(r) for r in h.mine(frame, F.col("id") % 5 == 0).collect()) == plainly(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("dimension", [2, 64, 130])
def test_no_product_is_outside_its_interval(dimension):
    rng = np.random.default_rng(dimension)
    points = np.floor(256 * rng.normal(size=(300, dimension)))
    turns = h.rotations(dimension)
    codes, ids = h.encode(points, turns), np.arange(300)
    anchors = h.prepare(ids[:20], ids[:20], points[:20], turns)
    for i in range(20):
        for r in range(300):
            true = float(points[r] @ points[i])
            assert list(h.surviving(codes, anchors, i, ids[r : r + 1], true, true)) == [r]


def test_intervals_spare_most_candidates():
    rng = np.random.default_rng(3)
    points = np.floor(256 * rng.normal(size=(4000, 64)) / 8)
    turns = h.rotations(64)
    codes, ids = h.encode(points, turns), np.arange(4000)
    anchors = h.prepare(ids[:30], ids[:30], points[:30], turns)
    stayed = [len(h.surviving(codes, anchors, i, ids[ids != i], -np.inf, np.inf, 5)) for i in range(30)]
    assert np.mean(stayed) < 0.05 * len(points)


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, folder).collect())
    assert got == plainly(rows, lambda i: i % 100 == 0) != []
