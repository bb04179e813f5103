"""Fingerprints, covering and groups against brute force."""

import itertools

import numpy as np
import pytest
import xxhash

from millrace.llm import components, op8, simhash


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """Component of each (key, fingerprint) by comparing everything."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            label[find(i)] = find(j)
    keys = {}
    for i, (key, _) in enumerate(rows):
        keys.setdefault(find(i), []).append(key)
    return [(key, min((k for k in keys[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("text", [
    "", None, " \n", "One", "one TWO", "a b c", "a b c d", "É a É a É", "x\x1cy z\x0bq r", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_any_half_within_one_bit_shares_an_anchor():
    rng = np.random.default_rng(3)
    halves = np.r_[rng.integers(0, 2**32, 200), [0, 2**32 - 1, 2**31]].astype(np.uint32)

    def anchors(x):
        return set(simhash.near_anchors(np.array([x], np.uint32))[1].tolist())

    for x in halves.tolist():
        mine = anchors(x)
        assert len(mine) in (2, 17)
        assert all((a ^ x).bit_count() <= 2 for a in mine)
        assert mine & anchors(x)
        assert all(mine & anchors(x ^ (1 << b)) for b in range(32))


def near(fp, flips, rng):
    for b in rng.choice(64, flips, replace=False).tolist():
        fp ^= 1 << b
    return fp


def clustered(rng, n):
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        out += [near(base, int(k), rng) for k in rng.integers(0, 6, 6)]
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("piece_rows", [4096, 2])
def test_links_join_what_brute_force_joins(spark, piece_rows):
    rng = np.random.default_rng(5)
    fps = sorted({*clustered(rng, 30), 0, 1, 2**64 - 1})
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(frame, piece_rows)).collect()}
    got = {}
    for x in fps:
        got.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    want = {}
    for x, low in slow_groups([(x, x) for x in fps]):
        want.setdefault(low, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).collect() == []


def test_groups_with_nulls_repeats_and_extra_columns(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [
        (5, base, "x"), (3, base + " tail", "x"), (3, base + " tail", "x"), (None, base, "x"), (9, None, "x"),
        (8, "", "x"), (4, "something else entirely here", "x"), (None, "quite alone in this table", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == sorted(slow_groups([(k, slow_fingerprint(t)) for k, t, _ in rows]), key=str)
    assert simhash.near_groups(docs.limit(0)).collect() == []


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    marked = [(r.doc_id, slow_fingerprint(r.text)) for r in docs]
    prints = dict(marked)
    want = dict(slow_groups(marked))
    got = op8.op8_simhash(spark, folder).collect()
    assert len(got) == len(docs)
    for row in got:
        assert row.fingerprint == f"{prints[row.doc_id]:016x}"
        assert row.component_id == want[row.doc_id]
