"""Scoring over ``documents``, ``labels`` and ``embeddings``."""

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F, types as T

from millrace import schemas, session
from millrace.functions.text import tumour_type, words
from millrace.operators import embedding, scoring
from millrace.plans import query
from millrace.sources import files
from millrace.sources.tables import load, texts

DICTIONARY = 10_000

ENCODED_SQL = rf"""
tokens AS (
  SELECT doc_id, text, CASE WHEN text <> '' AND regexp_replace(text, '\W+$', '') = '' THEN []
    ELSE string_split_regex(regexp_replace(text, '\W+$', ''), '\W+') END AS words
  FROM documents),
uses AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM tokens) WHERE word <> '' GROUP BY 1),
dictionary AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) + 3 AS code FROM uses ORDER BY n DESC, word LIMIT {DICTIONARY}),
placed AS (SELECT doc_id, unnest(words[1:255]) AS word, generate_subscripts(words[1:255], 1) AS pos FROM tokens),
coded AS (
  SELECT t.doc_id, coalesce(c.codes, []) AS codes
  FROM tokens t LEFT JOIN (
    SELECT doc_id, list(coalesce(code, 2) ORDER BY pos) AS codes
    FROM placed LEFT JOIN dictionary USING (word) GROUP BY doc_id) c USING (doc_id)),
encoded AS (SELECT doc_id, list_resize([1] || codes, 256, 0) AS codes FROM coded)
"""


def encoded(spark, sf_dir, chosen=None):
    """The codes of all texts, or of the ``chosen`` ones; the dictionary is that of all."""
    reviews = texts(spark, sf_dir)
    dictionary = scoring.frequent_words(reviews, size=DICTIONARY)
    return scoring.encode_reviews(reviews if chosen is None else chosen, "text", dictionary).drop("text")


@query("review_encode", f"WITH {ENCODED_SQL} SELECT doc_id, array_to_string(codes, ',') AS codes FROM encoded")
def review_encode(spark, sf_dir):
    whole = F.col("codes").cast("array<int>").cast("array<string>")
    return encoded(spark, sf_dir).select("doc_id", F.array_join(whole, ",").alias("codes"))


@query("score_batch", f"""WITH {ENCODED_SQL}
SELECT doc_id, len(list_filter(codes, lambda c: c > 2)) / 256.0::DOUBLE AS rating FROM encoded""")
def score_batch(spark, sf_dir):
    """Encoded texts through a model loaded once per worker; the stand-in model
    rates a text by its share of known words."""

    unknown = schemas.UNKNOWN_CODE

    def load_model():
        return lambda codes: (np.stack(codes.to_numpy()) > unknown).mean(axis=1)

    def apply(model, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "rating": model(batch["codes"])})

    return scoring.map_with_service(
        encoded(spark, sf_dir), "known_words", load_model, apply, "doc_id long, rating double")


@query("score_async", """
SELECT doc_id, (length(text) % 101) / 100.0::DOUBLE AS rating,
  'Sentiment rating for review "' || text || '" is ' || printf('%.2f', (length(text) % 101) / 100.0::DOUBLE) AS line
FROM documents""")
def score_async(spark, sf_dir):
    """One call per text, 16 at a time; the stand-in service answers by length."""
    rated = scoring.map_with_async_service(
        texts(spark, sf_dir), "length_service", lambda: (lambda text: len(text) % 101 / 100.0),
        lambda service, text: service(text), "text", "rating", T.DoubleType())
    return rated.select("doc_id", "rating", scoring.rating_line(F.col("text"), F.col("rating")).alias("line"))


CLASS_SQL = """
WITH parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centres AS (SELECT label AS predicted, pos, avg(x) AS c FROM parts GROUP BY 1, 2),
distances AS (
  SELECT vec_id, label, predicted, sum((x - c) * (x - c)) AS d FROM parts JOIN centres USING (pos) GROUP BY 1, 2, 3)
SELECT vec_id, label, arg_min(predicted, d) AS predicted, round(min(d), 6) AS distance
FROM distances GROUP BY 1, 2"""


@query("embedding_class", CLASS_SQL)
def embedding_class(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    centroids = scoring.class_centroids(vectors, "embedding", "label")
    nearest = scoring.nearest_class(vectors, "vec_id", "embedding", centroids)
    return vectors.select("vec_id", F.col("label").cast("int").alias("label")).join(nearest, "vec_id").select(
        "vec_id", "label", F.col("predicted").cast("int").alias("predicted"), F.round("distance", 6).alias("distance"))


#: Images packed into one file: a file each would be far more files than data.
IMAGES_PER_FILE = 10_000


@query("image_class", f"SELECT vec_id, predicted FROM ({CLASS_SQL})")
def image_class(spark, sf_dir):
    """Vectors as image files, several in each; their content is read back and classified."""
    place = session.scratch_path(spark, "images")
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    pixels = F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.col("embedding").cast("array<string>"), " "))
    vectors.select(pixels.alias("value")).write.option("maxRecordsPerFile", IMAGES_PER_FILE).text(place)
    packed = files.images(spark, place, "part-*").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("image"))
    parts = F.split("image", " ")
    images = packed.where("image <> ''").select(
        parts[0].cast("long").alias("vec_id"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("embedding"))
    nearest = scoring.nearest_class(images, "vec_id", "embedding", scoring.class_centroids(vectors, "embedding", "label"))
    return nearest.select("vec_id", F.col("predicted").cast("int").alias("predicted"))


# A row is tested on if its id's hash says so, whatever the partitions.
TEST_SQL = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 5 = 0"


def is_test():
    return F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 == 0


def labelled(spark, sf_dir):
    return texts(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id")


LABELLED_SQL = "labelled AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("gbt_match", f"""WITH {LABELLED_SQL}
SELECT doc_id, CASE WHEN quality = 1 THEN 'BENIGN' ELSE 'MALIGNENT' END AS actual, true AS line_agrees, true AS chances_fit
FROM labelled WHERE {TEST_SQL}""")
def gbt_match(spark, sf_dir):
    """Boosted trees on text measures; quality 1 plays the benign diagnosis.

    Trained numbers differ between engines, so the columns say what must hold: the
    rows, the actual type, and that line, prediction and chances agree. Training passes
    over its rows many times, so the measures are written once and the texts read once.
    """
    text = F.col("text")
    tokens = words(text)
    place = session.scratch_path(spark, "measures")
    measured = labelled(spark, sf_dir).select(
        "doc_id", F.when(F.col("quality") == 1, "B").otherwise("M").alias("diagnosis"),
        F.col("quality").cast("double").alias("label"),
        F.length(text).cast("double").alias("chars"), F.size(tokens).cast("double").alias("words"),
        F.size(F.array_distinct(tokens)).cast("double").alias("distinct_words"),
        F.size(F.split(text, "\n")).cast("double").alias("lines"),
        F.length(F.regexp_replace(text, r"\D", "")).cast("double").alias("digits"))
    measured.write.parquet(place)
    rows = spark.read.schema(measured.schema).parquet(place)
    measures = ["chars", "words", "distinct_words", "lines", "digits"]
    model = scoring.train_boosted_trees(rows.where(~is_test()), measures, "label")
    letter = F.when(F.col("prediction") == 1.0, "B").otherwise("M")
    matched = (
        rows.where(is_test()).transform(scoring.score_binary, model).withColumn("predicted", letter)
        .transform(scoring.match_diagnoses))
    chances = F.col("probabilities")
    verdict = F.when(F.col("diagnosis") == F.col("predicted"), "Match").otherwise("Miss")
    return matched.select(
        "doc_id", tumour_type(F.col("diagnosis")).alias("actual"),
        (F.startswith("line", F.concat(verdict, F.lit(":"))) & (F.col("matched") == (verdict == "Match"))).alias("line_agrees"),
        ((F.abs(chances[0] + chances[1] - 1) < 1e-9)
         & ((chances[1] > chances[0]) == (F.col("prediction") == 1.0))).alias("chances_fit"))


@query("text_classifier", f"""WITH {LABELLED_SQL}
SELECT doc_id, toxic::DOUBLE AS label, true AS chance_fits FROM labelled WHERE {TEST_SQL}""")
def text_classifier(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("label", F.col("toxic").cast("double"))
    model = scoring.train_text_classifier(rows.where(~is_test()), "text", "label")
    scored = scoring.classify_texts(rows.where(is_test()), "text", model)
    chance = F.col("probabilities")[1]
    return scored.select(
        "doc_id", "label",
        (chance.between(0, 1) & ((chance > 0.5) == (F.col("prediction") == 1.0))).alias("chance_fits"))


#: What the trained embeddings must reach on held-out texts: the chance that a toxic one is rated above another.
LEAST_RANKING = 0.7


@query("text_embedding", f"""WITH {LABELLED_SQL},
held AS (SELECT count(*) AS docs, sum(toxic)::BIGINT AS toxic FROM labelled WHERE {TEST_SQL})
SELECT docs, toxic, CASE WHEN toxic BETWEEN 1 AND docs - 1 THEN true END AS ranks_well FROM held""")
def text_embedding(spark, sf_dir):
    """Embeddings, mean and dense layer trained on the texts, then served; held-out ranking against a bar.

    Without both labels among the held-out texts there is no ranking. Only texts with a
    label are encoded, those to train on and those held out once each.
    """
    rows = encoded(spark, sf_dir, labelled(spark, sf_dir))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    model = embedding.train(rows.where(~is_test()), part, 4, DICTIONARY + schemas.RESERVED_CODES + 1, label="toxic")
    place = session.scratch_path(spark, "rated")
    embedding.rate_texts(rows.where(is_test()), model, ["doc_id", "toxic"]).write.parquet(place)
    rated = spark.read.parquet(place).withColumn("label", F.col("toxic").cast("double"))
    ranking = BinaryClassificationEvaluator(rawPredictionCol="rating").evaluate(rated)
    both = (F.col("toxic") > 0) & (F.col("toxic") < F.col("docs"))
    return rated.agg(F.count("*").alias("docs"), F.sum("toxic").cast("long").alias("toxic")).withColumn(
        "ranks_well", F.when(both, F.lit(ranking) >= LEAST_RANKING))


def _tumour_sql():
    """The CSV's text of a measure and what is read back from it."""
    return f"""WITH {LABELLED_SQL},
scored AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'BENIGN' ELSE 'MALIGNENT' END AS actual,
    least(length(text), 10000) / 10000.0::DOUBLE AS chance FROM labelled),
verdicts AS (SELECT *, CASE WHEN chance >= 0.1 THEN 'BENIGN' ELSE 'MALIGNENT' END AS predicted FROM scored)
SELECT doc_id, actual = predicted AS matched,
  CASE WHEN actual = predicted THEN 'Match' ELSE 'Miss' END || ': Actual: ' || rpad(actual, 15, ' ')
  || 'Prediction: ' || rpad(predicted, 20, ' ') || rpad(printf('%.4f', 1 - chance), 25, ' ')
  || rpad(printf('%.4f', chance), 25, ' ') AS line
FROM verdicts"""


@query("tumour_match", _tumour_sql())
def tumour_match(spark, sf_dir):
    """A CSV of the tumour layout, read, scored by a service with a fixed rule, and matched line by line."""
    place = session.scratch_path(spark, "tumours")
    share = F.least(F.length("text"), F.lit(10_000)) / 10_000.0
    cells = {"id": F.col("doc_id"), "diagnosis": F.when(F.col("quality") == 1, "B").otherwise("M")}
    names = [f.name for f in schemas.TUMOUR.fields]
    columns = [cells.get(n, share if i == 2 else F.lit(0.0)).alias(n) for i, n in enumerate(names)]
    labelled(spark, sf_dir).select(*columns).write.option("header", True).option("quoteAll", True).csv(place)
    rows = files.tumours(spark, place)
    measure = names[2]

    def rate(rule, batch: pd.DataFrame) -> pd.DataFrame:
        chance = batch[measure]
        return pd.DataFrame({
            names[0]: batch[names[0]], "diagnosis": batch["diagnosis"], "predicted": chance.map(rule),
            "probabilities": [[f"{1 - c:.4f}", f"{c:.4f}"] for c in chance]})

    scored = scoring.map_with_service(
        rows.select(names[0], "diagnosis", measure), "tumour_rule", lambda: (lambda c: "B" if c >= 0.1 else "M"), rate,
        f"{names[0]} {rows.schema[names[0]].dataType.simpleString()}, diagnosis string, predicted string, probabilities array<string>")
    return scored.transform(scoring.match_diagnoses).select(
        F.col(names[0]).cast("long").alias("doc_id"), "matched", "line")
