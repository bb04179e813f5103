"""Sentence classes rolled up to one score per text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import words
from millrace.operators.scoring import map_with_service

CLASSES = 5
NEUTRAL = 2


def sentence_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sentence): the sentences of each text in lower case."""
    sentence = F.explode(F.split(F.lower(F.col(text)), r"[.!?\n]+"))
    return texts.select(*keys, sentence.alias("sentence")).where(F.trim("sentence") != "")


def service_sentences(texts: DataFrame, keys: list[str], text: str, name: str,
                      load: Callable[[], Callable[[str], tuple[int, list[float]]]]) -> DataFrame:
    """(keys, class, probs) of every sentence by a scorer that is loaded once per worker."""
    rows = sentence_rows(texts, keys, text)
    columns = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def apply(scorer, batch: pd.DataFrame) -> pd.DataFrame:
        scored = [scorer(s) for s in batch["sentence"]]
        return batch[keys].assign(**{"class": [c for c, _ in scored], "probs": [p for _, p in scored]})

    return map_with_service(rows, name, load, apply, f"{columns}, class int, probs array<double>")


def lexicon_sentences(texts: DataFrame, keys: list[str], text: str, positive: list[str],
                      negative: list[str]) -> DataFrame:
    """Stand-in sentence scorer: (keys, class 0..4, five probabilities).

    The class moves from neutral by the balance of lexicon words; probabilities
    fall off with the distance from the class. Any scorer giving these columns
    can take its place.
    """
    tokens = words(F.col("sentence"))
    balance = F.size(F.filter(tokens, lambda w: w.isin(positive))) - F.size(
        F.filter(tokens, lambda w: w.isin(negative))
    )
    scored = (
        sentence_rows(texts, keys, text)
        .select(*keys, F.least(F.greatest(balance + NEUTRAL, F.lit(0)), F.lit(CLASSES - 1)).alias("class"))
    )
    weights = [1.0 / (1 + F.abs(F.lit(c) - F.col("class"))) for c in range(CLASSES)]
    whole = sum(weights[1:], weights[0])
    return scored.select(*keys, "class", F.array(*[w / whole for w in weights]).alias("probs"))


def sentiment_rollup(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Score per text from its non-neutral sentences; NaN if there are none.

    overall = (mean class - 2) / 2; the score is overall times the mean
    probability of the class that overall points to.
    """
    voiced = F.when(F.col("class") != NEUTRAL, F.col("class"))

    def mean_prob(index: int) -> Column:
        return F.avg(F.when(F.col("class") != NEUTRAL, F.col("probs")[index]))

    means = sentences.groupBy(*keys).agg(
        F.avg(voiced).alias("_mean"),
        *[mean_prob(i).alias(f"_p{i}") for i in range(CLASSES) if i != NEUTRAL],
    )
    overall = (F.col("_mean") - NEUTRAL) / 2
    share = (
        F.when(overall < -0.5, F.col("_p0")).when(overall < 0.0, F.col("_p1"))
        .when(overall < 0.5, F.col("_p3")).otherwise(F.col("_p4"))
    )
    return means.select(*keys, F.coalesce(overall * share, F.lit(float("nan"))).alias("score"))
