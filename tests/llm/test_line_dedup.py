"""Removed runs against the plain definition by maximal runs, and the SQL."""

import random

import oracle
import pytest

from millrace.llm import line_dedup, op6


def slow_dedup(rows, min_words):
    """rows of (key, text): the text of each without runs that occur earlier, by trying all runs."""
    # a row without a key is a document of its own
    rows, given = [(*r, i if r[0] is None else None) for i, r in enumerate(rows)], rows
    seen = {}
    for order, row in enumerate(rows):
        seen.setdefault(row, order)
    units = sorted(seen, key=lambda u: (u[0] is None, u[0] or 0, seen[u]))
    # every row takes part, also one that repeats a document
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    earlier, result = {}, {}
    lines = {u: [(i, x) for i, x in enumerate((u[1] or "").split("\n")) if x.split()] if u[1] is not None else [] for u in units}
    place = 0
    first_at = {}
    for n in order:
        content = [x for _, x in lines[rows[n]]]
        for i in range(len(content)):
            for j in range(i + 1, len(content) + 1):
                first_at.setdefault(tuple(content[i:j]), (place, i))
        place += 1
    place = 0
    for n in order:
        unit = rows[n]
        content = [x for _, x in lines[unit]]
        gone = set()
        for i in range(len(content)):
            for j in range(i + 1, len(content) + 1):
                run = tuple(content[i:j])
                if sum(len(x.split()) for x in run) >= min_words and first_at[run] < (place, i):
                    gone |= set(range(i, j))
        place += 1
        if unit in result:
            continue
        cut = set()
        for i in gone:
            cut.add(lines[unit][i][0])
            if i + 1 in gone:
                cut |= set(range(lines[unit][i][0], lines[unit][i + 1][0]))
        text = unit[1]
        result[unit] = (text if text is None or not cut else "\n".join(
            x for i, x in enumerate(text.split("\n")) if i not in cut), len(cut))
    return [(key, *result[row]) for (key, _), row in zip(given, rows, strict=True)]


def run(spark, rows, min_words):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lines int").coalesce(1)
    out = line_dedup.dedup(docs, min_words=min_words)
    assert out.columns == ["doc_id", "text", "lines", "lines_removed"]
    return sorted(((r.doc_id, r.text, r.lines_removed) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("min_words", [1, 5])
def test_random_documents(spark, seed, min_words):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(5)] + ["", "  "]
    rows = [(rng.randint(0, 40), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for _ in range(25)]
    assert run(spark, rows, min_words) == sorted(slow_dedup(rows, min_words), key=str)


def test_copies_passages_nulls_and_repeats(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(9)) for i in range(8))
    rows = [
        (1, f"own first\n{passage}\nown tail"), (2, f"{passage}\nother"), (3, "own first"), (None, passage), (4, None),
        (5, ""), (6, "\n\n"), (7, f"x\n{passage.replace(chr(10), chr(10) * 2)}\ny"), (8, f"x\n{passage}"), (8, f"x\n{passage}"),
        (9, "same line " * 30 + "\n" + "same line " * 30), (10, "z " * 20_000)]
    got = run(spark, rows, 50)
    assert got == sorted(slow_dedup(rows, 50), key=str)
    texts = {k: t for k, t, _ in got}
    assert texts[1] == rows[0][1] and texts[2] == "other" and texts[None] == "" and texts[7] == "x\ny" and texts[8] == ""
    assert texts[9] == "same line " * 30


def test_equal_texts_without_ids(spark):
    """Each row without an id is a document: of equal texts the first stays whole, also behind rows with ids."""
    text = "\n".join(" ".join(f"p{i}w{j}" for j in range(9)) for i in range(8))
    rows = [(None, text), (None, text), (7, "short text"), (None, text + "\nown end"), (None, "short text"), (None, None), (None, "")]
    got = run(spark, rows, 50)
    assert got == sorted(slow_dedup(rows, 50), key=str)
    assert sorted((t for _, t, _ in got), key=str) == sorted([text, "", "short text", "own end", "short text", None, ""], key=str)
    assert run(spark, [(3, text), *rows[:2]], 50) == [(3, text, 0), (None, "", 8), (None, "", 8)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(docs).collect() == []


def test_sql_over_a_whole_table(spark):
    rows, difference = oracle.compare(spark, "/root/testdata/sf0.01", op6.op6_line_dedup, op6.SQL)
    assert difference == "" and rows == 1000


def test_only_built_in_operations(spark):
    plan = op6.op6_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
