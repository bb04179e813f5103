"""Targets, copies and positions against plain Python, and running totals."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, op3, running


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, full = sum(sizes.values()), set()
    while True:
        rest = whole - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, target string")


def test_targets_are_reshared_until_none_is_over(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 12):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 2000, n) ** 2)} | {None: 7, "é": 100_000}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame, "source").collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-12)


def slow_positions(offset, knots):
    """Time at a share of the whole demand, by bisection."""
    def area(t):
        total = 0.0
        for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
            x = min(max(t - t0, 0.0), t1 - t0)
            total += r0 * x + (r1 - r0) / (t1 - t0) * x * x / 2
        return total

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if area(mid) < offset * area(1.0) else (low, mid)
    return high


def test_plan_against_plain_python(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"s{i % 4}", "w " * int(rng.integers(0, 60))) for i in range(200)]
    rows += [(1000 + i, "tiny", "a b c") for i in range(3)] + [(2000, None, "one two"), (2001, "s1", None), (None, "s2", "x y")]
    rows += [(3, "s3", "twice here")] * 2 + [(4000, "empty", ""), (4001, "long", "z " * 4000)]
    units = defaultdict(int)
    for r in rows:
        units[r] += 1
    size = {r: len(re.findall(mixing.WORD, r[2] or "")) for r in units}
    by_source = defaultdict(list)
    for r in units:
        by_source[r[1]].append(r)
    sizes = {s: sum(size[r] * units[r] for r in x) for s, x in by_source.items()}
    target = slow_targets(sizes)
    want = {}
    for s, members in by_source.items():
        kind = sorted(by_source, key=lambda x: (x is None, (x or "").encode())).index(s) % 3
        times = int(target[s] // sizes[s]) if sizes[s] else 0
        before = 0
        members.sort(key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], r[0] or 0, size[r]))
        for r in members:
            mass = size[r] * units[r]
            copies = (times + (before + mass / 2 <= target[s] - times * sizes[s])) * (mass > 0)
            at = [min(1.0, (i * sizes[s] + before + mass / 2) / target[s]) for i in range(copies)]
            want[r] = (size[r] * copies, [slow_positions(x, mixing.SHARES[kind].knots) for x in at])
            before += mass
    planned = mixing.plan(rows_of(spark, rows)).collect()
    assert len(planned) == len(units)
    total = defaultdict(int)
    for p in planned:
        same = [r for r in want if r[:2] == (p.doc_id, p.source) and size[r] == p.size]
        assert any(want[r][0] == p.taken and np.allclose(want[r][1], p.positions, atol=1e-9) for r in same)
        assert p.target == pytest.approx(target[p.source]) and p.source_size == sizes[p.source]
        assert p.taken <= 3 * p.size and p.positions == sorted(p.positions)
        total[p.source] += p.taken * p.rows
    for s in total:
        assert abs(total[s] - target[s]) <= max((size[r] * units[r] for r in by_source[s]), default=0) / 2 + 1


def test_mix_repeats_rows_in_training_order(spark):
    rows = [(i, f"s{i % 3}", f"text number {i}") for i in range(60)] + [(None, "s0", None)]
    docs = rows_of(spark, rows)
    plan = {r.doc_id: r for r in mixing.plan(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = [r.doc_id for r in mixed.collect()]
    assert sorted(got) == sorted(k for k, p in plan.items() for _ in p.positions)
    at = sorted((x, k) for k, p in plan.items() for x in p.positions)
    assert got == [k for _, k in at]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_the_cut_falls_inside_repeated_rows(spark):
    """A third of a source's words are one document's rows: each is placed on its own, as in the SQL."""
    rows = [(i, "a", "w " * 10) for i in range(60)] + [(1000, "a", "one")] * 300 + [(2000 + i, "b", "w " * 10) for i in range(117)]
    docs = rows_of(spark, rows)
    planned = mixing.plan(docs).collect()
    target = {p.source: p.target for p in planned}
    taken = {s: sum(p.taken * p.rows for p in planned if p.source == s) for s in target}
    assert sum(p.rows for p in planned) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    assert len([p for p in planned if p.doc_id == 1000]) == 2
    mixed = mixing.mix(docs).collect()
    assert {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in target} == taken


@pytest.mark.parametrize("part_rows", [1, 7, 1000])
def test_totals_before_whatever_the_parts(spark, part_rows):
    rows = [(i, "hot" if i % 3 else None, i % 5) for i in range(300)] + [(7, "hot", 2)]
    frame = spark.createDataFrame(rows, "k long, g string, v long").withColumn("h", F.xxhash64("k"))
    seen = defaultdict(int)
    want = []
    for r in sorted(frame.collect(), key=lambda r: (r.h, r.k)):
        want.append((r.k, r.g, seen[r.g]))
        seen[r.g] += r.v
    got = [(r.k, r.g, r.t) for r in running.totals_before(frame, ["g"], "h", ["k"], "v", "t", part_rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_reruns_and_sql_agree(spark):
    folder = "/root/testdata/sf0.01"
    rows, difference = oracle.compare(spark, folder, op3.op3_mixing, op3.SQL)
    assert difference == "" and rows == 1000
    assert op3.op3_mixing(spark, folder).collect() == op3.op3_mixing(spark, folder).collect()
