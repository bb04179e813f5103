"""Trees against a plain walk, held-out accuracy, and the edge cases."""

import zlib

import numpy as np

from millrace.llm import classifier, op4


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(classifier.FEATURES)))
    return x, ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)


def test_flat_arrays_score_as_a_plain_walk():
    forest = classifier.grow(*sample(800), trees=7, depth=3)
    x, _ = sample(50, seed=2)
    for row, got in zip(x, forest.score(x), strict=True):
        total = forest.base
        for split, bar, leaf in zip(forest.split, forest.bar, forest.leaf, strict=True):
            node = 0
            while node < len(split):
                f = split[node]
                here = sum(e < row[f] for e in forest.edges[f])
                node = 2 * node + (2 if here > bar[node] else 1)
            total += leaf[node - len(split)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_trees_learn_an_interaction():
    forest = classifier.grow(*sample(4000))
    x, y = sample(1000, seed=9)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_one_label_or_none_gives_a_constant():
    x, y = sample(20)
    assert len(set(classifier.grow(x, y * 0).score(x))) == 1
    assert classifier.grow(x[:0], y[:0]).score(x).tolist() == [0.5] * 20
    assert classifier.grow(x, y * 0 + 1).score(x)[0] > 0.7


def test_statistics_of_odd_texts():
    assert classifier.statistics(b"") == classifier.statistics(b" \n") == [0.0] * len(classifier.FEATURES)
    assert len(classifier.statistics("É | AB ab!\n".encode() * 9000)) == len(classifier.FEATURES)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(i, ("good plain words here " * 9) if i % 2 else "x### y*** " * 9, i) for i in range(60)]
    rows += [(1, None, 0), (None, "good", 0), (3, "", 0), (5, "word " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, sampled int")
    forest = classifier.train(docs, labels)
    out = classifier.score(docs, forest).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 for r in out)
    assert classifier.score(docs.limit(0), forest).collect() == []
    assert classifier.train(docs.limit(0), labels.limit(0)).score(np.zeros((1, len(classifier.FEATURES)))) == 0.5


def test_repeated_rows_of_a_key_count_once(spark):
    rows = [(i, ("good plain words here " * 9) if i % 2 else "x### y*** " * 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once, often = (classifier.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows + rows[:1] * 500))
    assert once.base == often.base and (once.leaf == often.leaf).all() and (once.split == often.split).all()


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op4.op4_quality_classifier(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    for label in (0, 1):
        hits = [p == t for p, t in held if t == label]
        assert sum(hits) > 0.95 * len(hits)


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    seen = labels.filter(~op4.held_out())
    assert seen.count() < labels.count()
    a, b = (classifier.train(docs, x) for x in (seen, seen.repartition(7)))
    assert a.base == b.base and (a.leaf == b.leaf).all() and (a.split == b.split).all()
