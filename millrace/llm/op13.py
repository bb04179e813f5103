"""op13: token ids of all documents into files and back."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace import session
from millrace.llm import token_files
from millrace.llm.registry import query, table


def _checksum(ids: np.ndarray) -> tuple[int]:
    return (crc32(np.ascontiguousarray(ids, "<u4")),)


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = session.scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder, _checksum, "ids_crc32 long")
