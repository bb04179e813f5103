"""Topic tagging of texts, and per-topic window statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace import schemas
from millrace.functions.numbers import is_finite, per_minute
from millrace.functions.text import topic_hits
from millrace.operators.ordered import number_rows
from millrace.operators.windows import latest_windows, pane_sums


def tag_topics(texts: DataFrame, text: str = "text",
               markers: dict[str, list[str]] = schemas.COIN_MARKERS) -> DataFrame:
    """One row per marker found, with ``topic`` and the text in lower case.

    A topic with two markers in one text gives two rows.
    """
    hits = F.explode(topic_hits(F.col(text), markers))
    return texts.withColumn("topic", hits).withColumn(text, F.lower(text))


def mentioning(texts: DataFrame, text: str = "text",
               markers: dict[str, list[str]] = schemas.COIN_MARKERS) -> DataFrame:
    """Only the texts with a marker, so that scoring leaves the others out."""
    return texts.where(F.size(topic_hits(F.col(text), markers)) > 0)


#: Markers of one automaton, which is sent to all tasks.
BLOCK_MARKERS = 20_000


def contained(texts: DataFrame, key: str, text: str, markers: DataFrame, marker: str,
              block_markers: int = BLOCK_MARKERS) -> DataFrame:
    """(key, marker): each marker of a table with each text that contains it, ignoring case.

    For many markers: all of a block are looked for at once by an automaton, in one pass
    over the texts per block, instead of one search per marker and text. Markers are in
    lower case and distinct in the result; empty ones and NULLs are in no text.
    """
    terms = markers.select(F.lower(F.col(marker)).alias("marker")).where("marker <> ''").distinct()
    numbered = number_rows(terms, ["marker"], "number").checkpoint()
    blocks = -(-numbered.count() // block_markers)
    lowered = texts.select(key, F.lower(F.col(text)).alias("text"))
    ddl = f"{key} {texts.schema[key].dataType.simpleString()}, marker string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def search(block: int) -> DataFrame:
        part = numbered.where(F.floor((F.col("number") - 1) / block_markers) == block)
        sent = texts.sparkSession.sparkContext.broadcast([r.marker for r in part.select("marker").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for word in sent.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                found = [sorted({w for _, w in automaton.iter(t)}) if t else [] for t in batch.column(1).to_pylist()]
                at = [i for i, words in enumerate(found) for _ in words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())).cast(schema[0].type),
                     pa.array([w for words in found for w in words], pa.string())], schema=schema)

        return lowered.mapInArrow(run, ddl)

    if not blocks:
        return texts.sparkSession.createDataFrame([], ddl)
    return reduce(DataFrame.union, [search(b) for b in range(blocks)])


def marker_terms(markers: dict[str, list[str]] = schemas.COIN_MARKERS) -> list[str]:
    """All markers as one list of search terms."""
    return [marker for topic_markers in markers.values() for marker in topic_markers]


def finite_scores(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.where(is_finite(F.col(score)))


def latest_topic_stats(scored: DataFrame, topic: str, time_ms: str, score: str,
                       windows: dict[str, int] = schemas.WINDOW_SIZES,
                       slide_ms: int = schemas.WINDOW_SLIDE_MS,
                       as_of_ms: int | None = None) -> DataFrame:
    """Last average, count and rate per (topic, window name), all windows in one table."""
    panes = pane_sums(scored, topic, time_ms, score, slide_ms)
    return latest_windows(panes, topic, windows, slide_ms, as_of_ms).withColumn(
        "per_minute", per_minute(F.col("count"), F.col("size_ms")))


def dense_stats(stats: DataFrame, topic: str, topics: list[str],
                windows: dict[str, int] = schemas.WINDOW_SIZES) -> DataFrame:
    """Every (topic, window) of two fixed lists, 0.0 where nothing was seen."""
    cells = F.array(*[
        F.struct(F.lit(t).alias(topic), F.lit(w).alias("window"))
        for t in topics for w in windows
    ])
    grid = stats.sparkSession.range(1).select(F.inline(cells))
    return grid.join(stats, [topic, "window"], "left").select(
        topic, "window",
        F.coalesce("avg", F.lit(0.0)).alias("avg"),
        F.coalesce("per_minute", F.lit(0.0)).alias("per_minute"),
    )
