"""Layouts, template and read-back."""

import hashlib
import json

import oracle
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, op1

HARD = [
    r"\### Assistant: </turn> ok", "", None, "#", "##", "###", "####", "#####", "\\", "\\\\", "\\b\\d\\s\\c", "<", "</", "<</turn>",
    "a </turn>\n### user: b", "ends with <", "ends with #", "\\##", "#\\#", "<\\/", " </turn>\n", "é: 👩‍👧 ß", "x" * 100_000]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_any_text_is_read_back(spark):
    turns = [(role, text) for text in HARD for role in ("user", "assistant", "tool: </ #", "", None)]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_turns(chat.turns_of_table(table.drop("formatted")))
    row = out.select(
        "formatted", chat.read_back(F.col("formatted")).alias("read"),
        chat.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned")).first()
    assert [tuple(t) for t in row["read"]] == [(r or "", t or "") for r, t in turns]
    assert row["learned"] == "".join(t or "" for r, t in turns if r == "assistant")
    assert row["formatted"].count(" </turn>\n") == len(turns)


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, "system and messages", [("system", "s"), ("user", "q")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
     "conversations", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": 7}, "instruction with input", [("user", "do\n\nthis"), ("assistant", "7")]),
    ({"instruction": "do", "input": "", "output": "x"}, "instruction with input", [("user", "do"), ("assistant", "x")]),
    ({"input": "i", "instruction": "do", "output": "x", "system": "s"}, "instruction with input and system",
     [("system", "s"), ("user", "do\n\ni"), ("assistant", "x")]),
    ({"prompt": "p", "completion": 1.5}, "prompt and completion", [("user", "p"), ("assistant", "1.5")]),
    ({"prompt": "p", "response": "c"}, "prompt and response", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": None}, "question and answer", [("user", "p"), ("assistant", "")]),
    ({"something": "else"}, None, []), ([1, 2], None, []), ({}, None, []),
]


def test_each_record_by_its_own_fingerprint(spark):
    rows = [(i, json.dumps(r), "x") for i, (r, _, _) in enumerate(RECORDS)] + [(98, "no json", "x"), (99, None, "x")]
    frame = spark.createDataFrame(rows, "id long, data string, layout string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.turns_of_records(frame, "id", "data").collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i] == (layout, turns)
    assert got[98] == got[99] == (None, [])


def test_tables_by_fingerprint(spark):
    rows = [(1, 2, "b", "late"), (1, 1, "a", "early"), (1, 2, "a", "tie"), (2, None, None, None), (None, 1, "x", "y")]
    for layout in chat.TABLES:
        names = [layout.key, layout.order, layout.role, layout.text]
        frame = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "long", "string", "string"), strict=True)))
        got = {r[0]: (r.layout, [tuple(t) for t in r.turns]) for r in chat.turns_of_table(frame).collect()}
        assert got == {
            1: (layout.name, [("a", "early"), ("a", "tie"), ("b", "late")]), 2: (layout.name, [("", "")]),
            None: (layout.name, [("x", "y")])}
        assert chat.turns_of_table(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_table(frame.drop(layout.text))


def test_sql_over_a_whole_table(spark):
    rows, difference = oracle.compare(spark, "/root/testdata/sf0.01", op1.op1_chat, op1.SQL)
    assert difference == "" and rows > 100
    trick = op1.op1_chat(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    assert trick.n_turns == 2 and trick.loss_chars == len(op1.TRICK) and trick.loss_sha256 == digest(op1.TRICK)
    assert trick.turns_sha256 == digest(f"user\n{op1.TRICK}\nassistant\n{op1.TRICK}\n")


def test_only_built_in_operations(spark):
    plan = op1.op1_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
