"""op10: every document's text through the tokenizer and back."""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe
from millrace.llm.registry import query, table

COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(codec: bpe.Codec, ids: list[int]) -> tuple[int, str, str]:
    return (
        len(ids), sha256(codec.numbers(ids).encode()).hexdigest(),
        sha256(codec.decode(ids).encode()).hexdigest())


def digests(docs: DataFrame) -> DataFrame:
    return bpe.transcode(docs, public_tokenizers.path("word_bpe_49k.json"), _digests, COLUMNS)


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
