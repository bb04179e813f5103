"""The curve itself, recall against brute force, ties and rows that take no part."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hilbert, op9


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 2), (4, 2), (2, 1)])
def test_the_curve_visits_each_cell_and_moves_by_one(axes, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=axes)))
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(rows, wanted, k):
    """rows of (id, vector): exact answers."""
    fine = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, x in fine:
        if wanted(q):
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in fine if i != q)
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_ties_copies_and_left_out_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 4)).round(1) + 0.05
    good = [(i, base[i % 7].tolist() if i < 40 else base[i].tolist()) for i in range(60)]
    odd = [
        (100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [math.nan, 1.0, 0.0, 0.0]),
        (104, [math.inf, 1.0, 0.0, 0.0]), (None, [1.0] * 4), (105, [1.0, 2.0]), (106, [])]
    frame = spark.createDataFrame([(*r, 1) for r in [*good, *odd, good[3]]], "vec_id long, embedding array<double>, id int")
    got = found(hilbert.search(frame, F.col("id") % 5 == 0))
    want = brute(good, lambda i: i % 5 == 0, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=0, atol=1e-12)


def test_few_rows_return_all(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (100, [5.0, 2.0])], "vec_id long, embedding array<float>")
    assert found(hilbert.search(frame, F.col("id") % 100 == 0)) == {0: [(1, 1.0), (100, 4.0)], 100: [(1, 3.0), (0, 4.0)]}
    assert hilbert.search(frame.limit(0), F.col("id") >= 0).collect() == []
    assert hilbert.search(frame.limit(1), F.col("id") >= 0).collect() == []


def test_pieces_change_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 8)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = found(hilbert.search(frame, F.col("id") % 20 == 0, curves=2))
    assert whole == found(hilbert.search(frame, F.col("id") % 20 == 0, curves=2, piece_rows=30, piece_queries=3))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_over_whole_tables(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    got = found(op9.op9_nearest(spark, f"/root/testdata/{folder}"))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        for i, d in near:
            assert d == pytest.approx(np.linalg.norm(exact[q] - exact[i]), abs=1e-12)
