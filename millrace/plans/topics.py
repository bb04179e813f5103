"""Topic tags over ``documents`` and window statistics over ``events``."""

import re

from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.text import topic_hits
from millrace.functions.times import epoch_ms
from millrace.operators import sentiment, topics, windows
from millrace.plans import query
from millrace.sources.tables import load, texts

SLIDE = schemas.WINDOW_SLIDE_MS
EVENT_TYPES = ["click", "error", "purchase", "refund", "signup", "view"]
POSITIVE = ["with", "that", "for", "avec", "para", "und"]
NEGATIVE = ["was", "from", "this", "sur", "las", "der"]


def _marker_rows():
    return ", ".join(
        f"('{topic}', '{marker}')" for topic, ms in schemas.COIN_MARKERS.items() for marker in ms)


def _windows_sql(size):
    return f"""
panes AS (
  SELECT event_type AS coin, (epoch_us(ts) // 1000) // {SLIDE} AS pane, sum(value) AS s, count(*) AS n
  FROM events GROUP BY 1, 2),
wins AS (
  SELECT coin, (pane + i) * {SLIDE} AS window_end, sum(s) / sum(n) AS a, sum(n)::BIGINT AS n
  FROM panes, range(1, {size // SLIDE + 1}) AS r(i) GROUP BY 1, 2)"""


def _latest_sql(size, name):
    return f"""SELECT coin, '{name}' AS win, max(window_end) AS window_end,
  round(arg_max(a, window_end), 8) AS avg_score, arg_max(n, window_end) AS mentions,
  round(arg_max(n, window_end) / ({size} / 60000.0::DOUBLE), 8) AS per_minute
FROM (WITH {_windows_sql(size)} SELECT * FROM wins) GROUP BY coin"""


LATEST_SQL = " UNION ALL ".join(_latest_sql(size, name) for name, size in schemas.WINDOW_SIZES.items())


def scored_events(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("coin"), epoch_ms(F.col("ts")).alias("ms"), "value")


@query("coin_mentions", f"""
SELECT doc_id, topic, lower(text) AS lowered
FROM documents JOIN (VALUES {_marker_rows()}) m(topic, marker) ON contains(lower(text), lower(marker))""")
def coin_mentions(spark, sf_dir):
    tagged = topics.tag_topics(texts(spark, sf_dir))
    return tagged.withColumnRenamed("text", "lowered")


@query("coin_sliding_30s", f"""WITH {_windows_sql(30_000)}
SELECT coin, window_end, round(a, 8) AS avg_score, n AS mentions FROM wins""")
def coin_sliding_30s(spark, sf_dir):
    segments = windows.sliding_segments(scored_events(spark, sf_dir), "coin", "ms", "value", 30_000, SLIDE)
    return windows.unfold_segments(segments, SLIDE).select(
        "coin", "window_end", F.round("avg", 8).alias("avg_score"), F.col("count").alias("mentions"))


@query("coin_sliding_5m", f"""WITH {_windows_sql(300_000)}
SELECT coin, window_end // 86400000 AS day, count(*) AS windows, sum(n)::BIGINT AS mentions,
  max(n) AS most_mentions, round(avg(a), 7) AS mean_score
FROM wins GROUP BY 1, 2""")
def coin_sliding_5m(spark, sf_dir):
    segments = windows.sliding_segments(scored_events(spark, sf_dir), "coin", "ms", "value", 300_000, SLIDE)
    return windows.windows_per_day(segments, "coin", SLIDE).select(
        "coin", "day", "windows", F.col("total").alias("mentions"), F.col("most").alias("most_mentions"),
        F.round("mean", 7).alias("mean_score"))


def latest_stats(spark, sf_dir):
    return topics.latest_topic_stats(scored_events(spark, sf_dir), "coin", "ms", "value")


@query("coin_latest", LATEST_SQL)
def coin_latest(spark, sf_dir):
    return latest_stats(spark, sf_dir).select(
        "coin", F.col("window").alias("win"), "window_end", F.round("avg", 8).alias("avg_score"),
        F.col("count").alias("mentions"), F.round("per_minute", 8).alias("per_minute"))


@query("coin_grid", f"""
WITH latest AS ({LATEST_SQL}),
grid AS (SELECT coin, win FROM (VALUES {", ".join(f"('{t}')" for t in EVENT_TYPES)}) c(coin),
         (VALUES ('HALF_MINUTE'), ('FIVE_MINUTES')) w(win))
SELECT coin, win, coalesce(avg_score, 0.0)::DOUBLE AS avg_score, coalesce(per_minute, 0.0)::DOUBLE AS per_minute
FROM grid LEFT JOIN latest USING (coin, win)""")
def coin_grid(spark, sf_dir):
    return topics.dense_stats(latest_stats(spark, sf_dir), "coin", EVENT_TYPES).select(
        "coin", F.col("window").alias("win"), F.round("avg", 8).alias("avg_score"),
        F.round("per_minute", 8).alias("per_minute"))


def _word_count(words):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(string_split_regex(s, '\\W+'), lambda w: w IN ({listed})))"


ROLLUP_SQL = rf"""
WITH sentences AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\n]+')) AS s FROM documents),
classed AS (
  SELECT doc_id, least(greatest(2 + {_word_count(POSITIVE)} - {_word_count(NEGATIVE)}, 0), 4) AS c
  FROM sentences WHERE trim(s) <> ''),
weighted AS (
  SELECT doc_id, c, [1.0::DOUBLE / (1 + abs(k - c)) FOR k IN range(0, 5)] AS w FROM classed WHERE c <> 2),
means AS (
  SELECT doc_id, (avg(c) - 2) / 2 AS overall, avg(w[1] / list_sum(w)) AS p0, avg(w[2] / list_sum(w)) AS p1,
    avg(w[4] / list_sum(w)) AS p3, avg(w[5] / list_sum(w)) AS p4
  FROM weighted GROUP BY doc_id)
SELECT doc_id, round(overall * CASE WHEN overall < -0.5 THEN p0 WHEN overall < 0 THEN p1
                                    WHEN overall < 0.5 THEN p3 ELSE p4 END, 9) AS score
FROM means"""


def document_scores(documents, keys):
    sentences = sentiment.lexicon_sentences(documents, keys, "text", POSITIVE, NEGATIVE)
    scores = topics.finite_scores(sentiment.sentiment_rollup(sentences, keys))
    return scores.select(*keys, F.round("score", 9).alias("score"))


@query("sentiment_rollup", ROLLUP_SQL)
def sentiment_rollup(spark, sf_dir):
    return document_scores(texts(spark, sf_dir), ["doc_id"])


@query("sentiment_service", ROLLUP_SQL)
def sentiment_service(spark, sf_dir):
    """The same roll-up with a scorer that is loaded once per worker."""
    positive, negative = set(POSITIVE), set(NEGATIVE)

    def load_scorer():
        def score(sentence):
            tokens = re.split(r"\W+", sentence, flags=re.ASCII)
            balance = sum(t in positive for t in tokens) - sum(t in negative for t in tokens)
            found = min(max(balance + 2, 0), 4)
            weights = [1 / (1 + abs(c - found)) for c in range(5)]
            return found, [w / sum(weights) for w in weights]

        return score

    sentences = sentiment.service_sentences(texts(spark, sf_dir), ["doc_id"], "text", "lexicon", load_scorer)
    scores = topics.finite_scores(sentiment.sentiment_rollup(sentences, ["doc_id"]))
    return scores.select("doc_id", F.round("score", 9).alias("score"))


@query("topic_sentiment", f"""
WITH scores AS ({ROLLUP_SQL}),
tagged AS (
  SELECT doc_id, topic FROM documents
  JOIN (VALUES {_marker_rows()}) m(topic, marker) ON contains(lower(text), lower(marker)))
SELECT topic, round(avg(score), 8) AS avg_score, count(*) AS mentions
FROM tagged JOIN scores USING (doc_id) GROUP BY topic""")
def topic_sentiment(spark, sf_dir):
    documents = topics.mentioning(texts(spark, sf_dir))
    tagged = documents.withColumn("topics", topic_hits(F.col("text"), schemas.COIN_MARKERS))
    scores = document_scores(tagged, ["doc_id", "topics"])
    return scores.select(F.explode("topics").alias("topic"), "score").groupBy("topic").agg(
        F.round(F.avg("score"), 8).alias("avg_score"), F.count("*").alias("mentions"))


@query("marker_texts", """
WITH markers AS (
  SELECT DISTINCT lower(w) AS marker FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE strlen(w) >= 6)
SELECT marker, count(*) AS texts, min(doc_id) AS first_text
FROM documents JOIN markers ON contains(lower(text), marker) GROUP BY marker""")
def marker_texts(spark, sf_dir):
    """Markers from a table, all looked for in one pass: texts that contain a long word of the benchmark."""
    words = load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("word")).where("length(word) >= 6")
    found = topics.contained(load(spark, sf_dir, "documents"), "doc_id", "text", words, "word")
    return found.groupBy("marker").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_text"))
