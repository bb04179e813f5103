"""The near-copy stage against the similarity of all pairs."""

import itertools
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from millrace import session
from millrace.llm import registry, shingles

FOLDER = "/root/testdata/sf0.01"


def slow_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in lowered.encode().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The smallest key of each component, by comparing everything."""
    sets = [(k, slow_set(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (j, x), (k, y) in itertools.combinations(sets, 2):
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(j), find(k)))
            root[b] = a
    return sorted(k for k in root if find(k) == k)


def kept(spark, rows):
    docs = corpus_pipeline.keep(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    return sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect())


@pytest.mark.parametrize("sample", [0, 20_000])
def test_similar_documents_whatever_is_common(spark, monkeypatch, sample):
    """Some words changed: most copies at a similarity near 0.8 lie more than 3 bits apart."""
    monkeypatch.setattr(shingles, "SAMPLE_ROWS", max(sample, 1))
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(3, 120)))] + ["this", "line", "is", "on", "every", "page"]
        rows.append((3 * i, " ".join(words)))
        for k in (1, 2):
            changed = list(words)
            for at in rng.integers(0, len(words), k + i % 4):
                changed[at] = f"Z{rng.integers(0, 9999)}"
            rows.append((3 * i + k, " ".join(changed)))
    rows += [(900, ""), (901, None), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "b a")]
    got = kept(spark, rows)
    assert got == slow_kept(rows)
    assert 66 < len(got) < len(rows) - 10


def test_fingerprints_link_what_lies_within_three_bits(spark, monkeypatch):
    """Without the prefixes only pairs within 3 bits are linked, and only those whose sets reach the similarity."""
    for step in ("_spokes", "_rest"):
        monkeypatch.setattr(shingles, step, lambda *_: spark.createDataFrame([], "a long, b long, an long, bn long"))
    rng, rows = np.random.default_rng(5), [(900, ""), (901, None)]
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 4000, 400)]
        for k in range(3):
            rows.append((3 * i + k, " ".join([*words, *(f"Z{x}" for x in rng.integers(0, 9999, k))])))
    rows += [(910, "a b c d e f"), (911, "a b c d e f g")]  # few shingles: near in bits by chance at most
    bits = {k: shingles.simhash.majority(shingles.shingle_set((t or "").encode()).view(np.uint64)) for k, t in rows}
    sets = {k: slow_set(t) for k, t in rows}
    first = {k: k for k in sets}
    for j, k in itertools.combinations(sorted(sets), 2):
        x, y = sets[j], sets[k]
        if x == y or ((bits[j] ^ bits[k]).bit_count() <= 3 and 5 * len(x & y) >= 4 * len(x | y)):
            low, high = sorted((first[j], first[k]))
            first = {n: low if r == high else r for n, r in first.items()}
    docs = corpus_pipeline.keep(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    got = {r.doc_id: r.component_id for r in shingles.near_groups(docs, "doc_id").collect()}
    assert got == first
    assert 1 < len({k for k, r in first.items() if k != r and k < 900}) < 80


def test_all_pairs_of_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert kept(spark, rows) == slow_kept(rows)


def test_tables_and_shuffles_of_the_stage_go(spark):
    """What the stage keeps on its way, and what it shuffles, is gone when it has its result."""
    rng, rows = np.random.default_rng(3), []
    for i in range(100):
        words = [f"w{x}" for x in rng.integers(0, 4000, 60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:57], "x", "y", "z"]))]
    docs = corpus_pipeline.keep(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    shared = Path(session.checkpoint_dir(spark).removeprefix("file:"))
    before = set(shared.glob("millrace-*"))
    near = corpus_pipeline.near_copies(spark, docs, FOLDER)
    assert {p.name.split("-")[1] for p in set(shared.glob("millrace-*")) - before} == {"kept"}
    assert near.count() == 100
    counted = docs.groupBy("text").count()
    for _ in range(2):
        shuffles = spark.sparkContext._jsc.sc().newShuffleId()
        registry.keep(counted, "counted")
        made = range(shuffles + 1, spark.sparkContext._jsc.sc().newShuffleId())
        tracked = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        assert made and not any(tracked.containsShuffle(i) for i in made)
    assert spark.conf.get(session.SHUFFLES_GO, None) is None


def test_keep_only_removes_what_was_kept_on_the_way(spark):
    shared = Path(session.checkpoint_dir(spark).removeprefix("file:"))
    before = set(shared.glob("millrace-*"))
    outside = registry.keep(spark.range(5), "outside")

    def inner():
        return registry.keep(outside, "deep").filter("id > 1")

    def outer():
        return registry.keep_only(inner, "inner").union(registry.keep(outside, "way"))

    assert registry.keep_only(outer, "whole").count() == 8
    assert {p.name.split("-")[1] for p in set(shared.glob("millrace-*")) - before} == {"outside", "whole"}
    assert outside.count() == 5
