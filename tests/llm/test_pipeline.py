"""The pipeline against its stages done plainly, one after another."""

from hashlib import sha256

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from millrace.llm import classifier, op3, op4, op6
from test_shingles import slow_kept

FOLDER = "/root/testdata/sf0.01"


def sql_over(docs, sql):
    """The rows of a query of another engine over the given documents."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[k, t, s] for k, (t, s) in docs.items()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return [dict(zip(names, row, strict=True)) for row in result.fetchall()]


def plainly(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = classifier.score(frame, op4.forest(spark, frame, FOLDER)).collect()
    docs = {r.doc_id: (r.text, r.source) for r in scored if r.score >= 0.7}
    yield docs
    cut = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in sql_over(docs, op6.SQL)}
    docs = {k: (cut[k][0], s) for k, (_, s) in docs.items() if not cut[k][1] or cut[k][0].split()}
    yield docs
    docs = {k: docs[k] for k in slow_kept([(k, t) for k, (t, _) in docs.items()])}
    yield docs
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in sql_over(docs, op3.SQL) if r["size"]}
    yield sorted((k, docs[k][0]) for k, n in taken.items() for _ in range(n))


def test_every_stage_and_the_whole(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixing", "tokens"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for (_, stage), want in zip(corpus_pipeline.STAGES, plainly(spark), strict=False):
        docs = corpus_pipeline.keep(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        assert got == (want if isinstance(want, list) else sorted((k, t) for k, (t, _) in want.items()))
        assert docs.filter("n_chars <> length(text)").count() == 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = {k: sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for k, t in got}
    whole = driver.queries()["pipeline"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((k, digest[k]) for k, _ in got)


def test_odd_rows_pass_every_stage(spark):
    rows = [
        (1, "plain words of a text that says something about the day and the night", "en", "a", 70, 1),
        (1, "plain words of a text that says something about the day and the night", "en", "a", 70, 2),
        (None, "another text that has no id at all but some words in it anyway", None, None, None, 3),
        (2, None, None, None, None, 4), (3, "", "en", "b", 0, 5), (4, "long " * 30_000, "en", "b", 1, 6)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score int"
    for frame in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.keep(stage(spark, docs, FOLDER), "odd")
            assert docs.columns == frame.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    marked = spark.createDataFrame(rows, names)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, marked, FOLDER).collect()) == ["1", "2", "4", "None"]


def test_names_of_other_columns_meet_none_of_a_stage(spark):
    """Columns named like those a stage makes come out as they went in; of equal rows the first by its other columns stays."""
    text = "some words that make a text of more than a few words about a thing and another"
    rows = [(1, text, "en", "z", 80, 7, 8, 9), (1, text, "en", "b", 80, 7, 8, 9), (2, "other " + text * 3, "en", "b", 1, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long, b long, lines_removed long")
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_copies):
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        got = sorted((r.doc_id, r.a, r.b, r.lines_removed) for r in out.collect())
        assert set(got) == {(1, 7, 8, 9), (2, 5, 6, 7)}
    assert sorted(r.source for r in out.collect()) == ["b", "b"]
