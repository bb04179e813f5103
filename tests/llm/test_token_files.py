"""Token files: numbers and files read back as they were, ids those of the library."""

import json
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace import session
from millrace.llm import token_files as t
from millrace.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plainly(library, rows):
    """(doc_id, start, ids) in the order of the files."""
    ids = [(k, library.encode(x or "", add_special_tokens=False).ids + [1]) for k, x in rows]
    ids = sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), crc32(np.array(r[1], "<u2").tobytes())))
    starts = np.cumsum([0] + [len(x) for _, x in ids]).tolist()
    return [(k, s, x) for (k, x), s in zip(ids, starts)]


def round_trip(spark, frame, **options):
    folder = session.scratch_path(spark, "test-tokens")
    t.write(frame, folder, PATH, **options)
    rows = t.read(spark, folder, lambda ids: (ids.tolist(),), "ids array<long>").collect()
    return folder, sorted(((r.doc_id, r.start, r.ids) for r in rows), key=lambda r: r[1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(65_530, 65_540)))
def test_numbers_come_back(numbers):
    n = np.array(numbers, np.uint32)
    control, data = t.pack(n)
    assert len(control) == -(-len(n) // 4)
    assert t.unpack(control, data, len(n)).tolist() == numbers


def test_frequent_numbers_take_one_byte():
    control, data = t.pack(np.arange(256, dtype=np.uint32))
    assert (len(control), len(data)) == (64, 256)


def test_odd_texts(spark, library):
    long = " ".join(f"word{i % 977} Ünï{i % 31}" for i in range(60_000))
    rows = [(3, "Hello,  World!\n\nhello"), (1, None), (2, ""), (None, "null id"), (None, None), (5, long), (4, "x" * 5000),
            (7, "a<|endoftext|>b <|startoftext|>"), (8, "a\x1cb　c\u0085d e f\tg\r\nh\x0bi"), (9, "é ́x ΑΣ Σ"),
            (6, "日本語 テキスト 🎉🎉"), (10, "\x00\x01 �"), (11, "same"), (11, "same"), (11, "other one"), (-4, "below")]
    _, got = round_trip(spark, spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert got == plainly(library, rows)


def test_one_id_and_clashing_names(spark, library):
    rows = [(1, f"copy {i % 3}") for i in range(300)] + [(None, "x")] * 300 + [(2, "y")]
    frame = spark.createDataFrame(rows, COLUMNS).withColumns(
        {n: F.lit(1) for n in ("key", "row", "n", "ids", "start", "part", "block", "n_tokens", "content")})
    _, got = round_trip(spark, frame)
    assert got == plainly(library, rows)


def test_empty_table(spark):
    assert round_trip(spark, spark.createDataFrame([], COLUMNS))[1] == []


def test_files_blocks_and_manifest(spark, library):
    rows = [(i * 37 % 500, f"w{i} the the {'z ' * (i % 7)}") for i in range(500)]
    folder, got = round_trip(spark, spark.createDataFrame(rows, COLUMNS), block_ids=50)
    expected = plainly(library, rows)
    assert got == expected
    ranking = spark.read.parquet(f"{folder}/ranking").orderBy("number").collect()
    assert [r["count"] for r in ranking] == sorted((r["count"] for r in ranking), reverse=True)
    assert sum(r["count"] for r in ranking) == sum(len(x) for _, _, x in expected)
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("part", "block").collect()
    assert len(manifest) > 10
    assert [r.start for r in manifest] == np.cumsum([0] + [r.ids for r in manifest])[:-1].tolist()
    files = spark.read.format("binaryFile").load(f"{folder}/blocks").orderBy("path").collect()
    assert b"".join(f.content for f in files).count(np.uint64(t.MAGIC).tobytes()) == len(manifest)


def test_a_damaged_file_is_an_error(spark):
    folder, _ = round_trip(spark, spark.createDataFrame([(1, "one two three")], COLUMNS))
    block = spark.read.format("binaryFile").load(f"{folder}/blocks").filter("length > 0").first().content
    damaged = session.scratch_path(spark, "test-damaged")
    broken = bytes(block[:-2]) + bytes([block[-2] ^ 1])
    spark.createDataFrame([(broken,)], "b binary").select(F.col("b").cast("string")).write.text(f"{damaged}/blocks")
    spark.read.parquet(f"{folder}/ranking").write.parquet(f"{damaged}/ranking")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{damaged}/manifest")
    with pytest.raises(Exception, match="damaged block"):
        t.read(spark, damaged, lambda ids: (len(ids),), "n long").collect()


def test_words_are_forgotten_and_learnt_again(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(t, "REMEMBERED_WORDS", 20)
    with open(PATH, encoding="utf-8") as file:
        encoder = t.Encoder(file.read())
    for i in range(20):
        texts = [f"word{j % (3 + i)} some{i} {'long' * 40}" for j in range(10)]
        flat, counts = encoder.encode(pa.array(texts))
        expected = [library.encode(x, add_special_tokens=False).ids for x in texts]
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == expected
        assert len(encoder._place) <= 20 + 10 * 3


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def encoded(spec, texts):
    flat, counts = (encoder := t.encoder_of(spec)).encode(pa.array(texts, pa.string()))
    return encoder, [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_a_word_with_marks_and_capitals_is_learnt_once(library, spec):
    t.encoder_of.cache_clear()
    texts = [f"{a}{w}{b}" for w in ("thering", "THERING", "Thering", "Été", "été", "ÉTÉ") for a in ("", "(") for b in ("", ",", ".", "!!", "7")]
    encoder, got = encoded(spec, texts)
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert set(encoder._place) == {x.encode() for x in ("thering", "été", "(", ",", ".", "!!", "7")}


@settings(max_examples=500, deadline=None)
@given(st.lists(st.none() | st.text("aZsStTré É ÀÞßÿĀ×÷'<|>12.,!\u0301\xa0\x85\x1c\x7f\x00\t\n€ΣİſK½²ªデ🎉", max_size=25), max_size=6))
def test_every_kind_of_byte_is_cut_as_the_library_does(library, spec, texts):
    texts = [*texts, "don't we'll it's !'s 's5 'sun", "x<|endoftext|>É", "B" * 300 + "×É"]
    assert encoded(spec, texts)[1] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    {"added_tokens": [{"id": 49406, "content": "Éz", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]},
])
def test_other_steps_before_the_model_are_left_to_the_library(spec, change):
    spec = json.dumps(json.loads(spec) | change)
    texts = ["HELLO, Été-42!", None, "hello", "xÉz éz ÉZ"]
    other = Tokenizer.from_str(spec)
    words = [[i for w in (x or "").split() for i in other.encode(w, add_special_tokens=False).ids] for x in texts]
    assert encoded(spec, texts)[1] == words


def test_a_slice_of_texts_is_cut_at_its_own_borders(library, spec):
    texts = pa.array(["no", "end", "start", None, "", "é1", "Last"]).slice(1, 5)
    flat, counts = t.Encoder(spec).encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [
        library.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]


def test_a_long_text_is_encoded_in_sections(library, spec, monkeypatch):
    monkeypatch.setattr(t, "RUN_CHARS", 20)
    text = " Été,\nn° 12 don't\t" * 30 + "x" * 100 + "  end"
    sections = list(t._sections(pa.array([text])))
    assert "".join(x[0].as_py() for x in sections) == text
    assert max(len(x[0].as_py()) for x in sections) <= 120
    for x in (text, "y" * 50, "", " ", None, "z" * 20 + " "):
        assert encoded(spec, [x])[1] == [library.encode(x or "", add_special_tokens=False).ids]


def test_query_on_a_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, folder).collect())
    assert got == sorted((k, s, len(x), crc32(np.array(x, "<u4").tobytes())) for k, s, x in plainly(library, rows))
