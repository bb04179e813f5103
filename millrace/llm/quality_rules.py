"""Quality rules: statistics of one text, and lines that too many documents of a host carry.

Lines are normalised (A-Z lowered, digits as 0, white space as one space, trimmed)
and hashed; each distinct document counts once per line and host, and texts equal after
normalising are one document. Lines above the limit are boilerplate and are taken away;
a document is rejected if too little is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import arrow_schema
from millrace.llm.registry import keep

#: A line is boilerplate if more distinct documents of its host carry it than this number.
#: It does not grow with the host: in tables of 10,000 and 51,000 documents the lines carried by
#: 2 to 10 documents hold 20 to 40 words on average (passages, near copies), those above about 10.
LINE_DOCS = 10

#: A document is depleted if fewer words than this number, or this share of its words, are left.
LEFT_WORDS, LEFT_SHARE = 10, 0.30

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five words that occur twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:-WINDOW] += starts
    covered[WINDOW:] -= starts
    return int((np.cumsum(covered) > 0).sum())


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(b"".join(words).decode()), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words))


def _digest(data: bytes) -> int:
    digest = xxhash.xxh64_intdigest(data)
    return digest - ((digest >> 63) << 64)


def line_words(text: bytes) -> tuple[int, list[int], list[int]]:
    """Hash of all normalised lines with a word, hashes of the distinct ones, and the words of all their occurrences."""
    lines = [words for line in text.translate(_NORMAL).split(b"\n") if (words := line.split())]
    normal = [b" ".join(words) for words in lines]
    found: dict[int, int] = {}
    for words, line in zip(lines, normal, strict=True):
        digest = _digest(line)
        found[digest] = found.get(digest, 0) + len(words)
    return _digest(b"\n".join(normal)), list(found), list(found.values())


def measured(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """(key, host, row, statistics, print, lines, line_words), kept as a table; row numbers each row of it."""
    types = {c: docs.schema[c].dataType.simpleString() for c in (key, host)}
    ddl = f"{key} {types[key]}, {host} {types[host]}, row long, {STATS}, print long, lines array<long>, line_words array<long>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            columns = list(zip(*((*text_stats(t), *line_words(t)) for t in texts), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(schema[0].type), batch.column(1).cast(schema[1].type),
                pa.array(np.arange(row, row + len(texts))),
                *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[3:], strict=True))], schema=schema)
            row += len(texts)

    return keep(docs.select(key, host, text).mapInArrow(run, ddl), "measured")


def frequent_lines(rows: DataFrame, host: str, line_docs: int = LINE_DOCS) -> DataFrame:
    """(host, line) of lines that more distinct documents of a host carry than the limit allows."""
    counts = rows.select(host, "print", F.explode("lines").alias("line")).groupBy(host, "line").agg(
        F.count_distinct("print").alias("n"))
    return counts.filter(F.col("n") > line_docs).select(F.col(host).alias("of_host"), F.col("line").alias("of_line"))


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(
    docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
    line_docs: int = LINE_DOCS,
    left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE,
) -> DataFrame:
    """(key, statistics, base_failed, removed_words, kept) of every row.

    Null text: no words, so the base rules fail it. A null host is a host of its own.
    Repeated rows and texts equal after normalising count as one document of their host,
    and each of them gets the same verdict. Whole texts are read once; what is shuffled
    is one number per line and document.
    """
    rows = measured(docs, key, host, text)
    frequent = keep(frequent_lines(rows, host, line_docs), "frequent-lines")
    lines = rows.select("row", host, F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "row", host, F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = lines.join(
        frequent, (F.col("line") == F.col("of_line")) & F.col(host).eqNullSafe(F.col("of_host"))
    ).groupBy("row").agg(F.sum("words").alias("removed_words"))
    judged = rows.drop("print", "lines", "line_words").join(removed, "row", "left").fillna(0, ["removed_words"])
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < left_words) | (left < left_share * F.col("n_words"))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row")
