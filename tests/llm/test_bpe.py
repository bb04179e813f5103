"""The encoder against the tokenizers library, and the round trip."""

import functools
import random
import tracemalloc
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, op10

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello don't  WORLD<|endoftext|>ΑΣ ΑΣ² café 123 İx ａ\x1cb 　z ​q \u0085k ½", "", "  \n",
    "<|endoftext|><|endoftext|> a<|startoftext|>", "'s's 've'll ''dd _a_ b_c", "aaaaaaaaaaa abababab",
    "日本語テキスト 👩‍👩‍👧 é ́x", "<|ENDOFTEXT|>", "x" * 5000, "the the the",
]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizer()


@pytest.fixture(scope="module")
def codec():
    return bpe.codec_of(open(PATH, encoding="utf-8").read())


def test_odd_texts_encode_as_the_library(library, codec):
    for text, ids in zip(ODD, codec.encode_batch(ODD), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdehinorst '.,1!é<|ßΣ \n\t"), max_size=60))
def test_any_text_encodes_as_the_library(text):
    codec, library = bpe.codec_of(open(PATH, encoding="utf-8").read()), tokenizer()
    assert codec.encode_batch([text]) == [library.encode(text, add_special_tokens=False).ids]


def test_words_are_forgotten_without_harm(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    small = bpe.Codec(open(PATH, encoding="utf-8").read())
    texts = ["one two three four five six", "seven eight one two", "nine ten eleven"]
    for _ in range(2):
        assert small.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_remembered_word_takes_few_bytes():
    """A worker keeps its words while other stages run: with tuples of numbers they took 339 bytes each."""
    codec, letters = bpe.Codec(open(PATH, encoding="utf-8").read()), random.Random(3)
    texts = [" ".join("".join(letters.choices("abcdefghijklmnop", k=14)) for _ in range(500)) for _ in range(40)]
    codec.encode_batch(["warm up"])
    tracemalloc.start()
    codec.encode_batch(texts)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(codec._known) > 20_000
    assert held < 200 * 20_000


def test_query_over_nulls_repeats_and_extra_columns(spark, library):
    rows = [(1, None, 7), (1, None, 7), (None, "the end", 8), (2, "", 9), (3, "wörd " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, op10.digests(docs).collect()), key=str)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        whole = library.decode(ids, skip_special_tokens=False)
        digests = (sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(whole.encode()).hexdigest())
        want.append((key, len(ids), *digests))
    assert got == sorted(want, key=str)
    assert op10.digests(docs.limit(0)).collect() == []


def test_encode_and_decode_frames(spark, library):
    docs = spark.createDataFrame([(1, "Some words"), (2, None)], "doc_id long, text string")
    tokens = bpe.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in tokens.collect()} == {
        1: library.encode("Some words", add_special_tokens=False).ids, 2: []}
    assert {r.doc_id: r.text for r in bpe.decode(tokens, PATH).collect()} == {1: "some</w> words</w>", 2: ""}


def test_whole_small_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in op10.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    for row in docs.collect():
        ids = library.encode(row.text, add_special_tokens=False).ids
        assert got[row.doc_id] == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
