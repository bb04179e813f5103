"""The hash tree against one built plainly."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle
from millrace.llm.queries import QUERIES

COLUMNS = "doc_id long, source string, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(digests):
    """Levels of a tree, lowest first."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, place):
    """(left siblings, right siblings) per level."""
    out = []
    for level in tree[:-1]:
        run = place // 3 * 3
        out.append(("".join(level[run:place]), "".join(level[place + 1 : run + 3])))
        place //= 3
    return out


def plainly(rows, replace):
    """rows: tuples that begin with key and group; ``replace`` gives the tampered row."""
    groups = {}
    for r in rows:
        leaf = h(*map(written, r))
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf, r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    top = up([trees[g][-1][0] for g in names])
    out = []
    for g in names:
        for place, (_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            steps = way(trees[g], place) + way(top, names.index(g))
            digest = h(*map(written, replace(r)))
            for left, right in steps:
                digest = h(left, digest, right)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*(x for s in steps for x in s)), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def shorter(r):
    return (*r[:2], r[2].replace("a", "") if r[2] is not None and r[0] is not None and r[0] % 2 else r[2])


def found(spark, rows, more=(), **options):
    frame = spark.createDataFrame(rows, COLUMNS).withColumns({n: F.lit(1) for n in more})
    columns = [F.col(c) for c in ("doc_id", "source", "text")]
    cut = F.when(F.pmod("doc_id", F.lit(2)) == 1, F.replace("text", F.lit("a"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(frame, "doc_id", "source", columns, [*columns[:2], cut], **options).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 28, 731])
def test_trees_of_any_size(spark, n):
    rows = [(i, "s", f"a{i}" if i % 3 else f"b{i}") for i in range(n)]
    assert found(spark, rows) == plainly(rows, shorter)


def test_small_blocks_make_several_rounds(spark):
    rows = [(i * 7 % 101, f"s{i % 5 * (i % 2)}", "a" * i) for i in range(101)]
    assert found(spark, rows, height=1) == plainly(rows, shorter)


def test_many_groups_and_a_hot_one(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 200}", f"xa{i}") for i in range(3000)]
    assert found(spark, rows) == plainly(rows, shorter)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, None, None), (None, None, "a"), (None, "", ""), (3, "", "a"), (3, "", "b"), (3, "", "a"),
            (4, "é", "añ\n" * 50_000), (5, "z", "a"), (5, "Z", "a"), (-1, "z", "a")] + [(7, "z", "same")] * 20
    assert found(spark, rows) == plainly(rows, shorter)
    names = ("tree", "pos", "n", "digest", "other", "row", "one", "leaf", "root", "key", "block")
    assert found(spark, rows, names) == plainly(rows, shorter)


def test_a_parent_folds_like_a_new_one():
    children = [b"a" * 64, b"b" * 64, b"c" * 64]
    parent = merkle.Parent(children)
    for slot in range(3):
        other = children[:slot] + [b"x"] + children[slot + 1 :]
        assert parent.fold(slot, b"x") == merkle.Parent(other).digest
        assert parent.beside(slot) == (b"".join(children[:slot]), b"".join(children[slot + 1 :]))


def test_query_finds_what_was_tampered_with(spark):
    folder = "/root/testdata/sf0.001"
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = [tuple(r[n] for n in names) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]

    def tampered(r):
        even = crc32(str(r[0]).encode()) % 2 == 0
        return (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])

    got = sorted((tuple(r) for r in QUERIES["op12_merkle"](spark, folder).collect()), key=repr)
    expected = plainly(rows, tampered)
    assert got == expected
    changed = {r[0] for r in rows if tampered(r) != r}
    assert changed and {r[0] for r in got if not r[6]} == changed
