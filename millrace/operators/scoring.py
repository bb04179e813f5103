"""Model scoring: services in the workers, encoded reviews, Spark ML models."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from millrace import schemas
from millrace.functions.text import left_aligned, padded_codes, tumour_type, words

# The helpers below travel with the job, also to workers without the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors and classes that one task compares.
PIECE_VECTORS, BLOCK_CLASSES = 50_000, 1_000


def worker_service(name: str, load: Callable[[], Any]) -> Any:
    """The service called ``name``, loaded once per Python worker process."""
    store = sys.modules.setdefault("millrace_services", types.ModuleType("millrace_services"))
    if not hasattr(store, name):
        setattr(store, name, load())
    return getattr(store, name)


def map_with_service(df: DataFrame, name: str, load: Callable[[], Any],
                     apply: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Map Arrow batches with a shared service such as a loaded model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = worker_service(name, load)
        for batch in batches:
            yield apply(service, batch)

    return df.mapInPandas(run, schema)


def map_with_async_service(df: DataFrame, name: str, load: Callable[[], Any],
                           call: Callable[[Any, Any], Any], column: str, result: str,
                           result_type: T.DataType, in_flight: int = 16) -> DataFrame:
    """Add ``result`` from one service call per row, ``in_flight`` at a time, in row order."""
    schema = T.StructType([*df.schema.fields, T.StructField(result, result_type)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = worker_service(name, load)
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                batch[result] = list(pool.map(lambda value: call(service, value), batch[column]))
                yield batch

    return df.mapInPandas(run, schema)


def attach(spark: SparkSession, path: str, folder: bool = False) -> str:
    """Ship a file or a folder with the job; tasks open it by ``SparkFiles.get(<returned name>)``."""
    spark.sparkContext.addFile(path, recursive=folder)
    return path.rstrip("/").rsplit("/", 1)[-1]


# --- Reviews -----------------------------------------------------------------

def frequent_words(texts: DataFrame, text: str = "text", size: int = 10_000) -> DataFrame:
    """Dictionary (word, code) of the ``size`` most frequent words, best first.

    Codes start above the reserved ones. The final rank runs over ``size`` rows.
    """
    counts = (
        texts.select(F.explode(words(F.col(text))).alias("word"))
        .where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("uses"))
    )
    top = counts.orderBy(F.desc("uses"), "word").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("uses"), "word"))
    return top.select("word", (rank + schemas.RESERVED_CODES).cast("int").alias("code"))


def encode_reviews(texts: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Add ``codes``: start code, then word codes, cut or padded to 256 floats.

    The dictionary is bounded by its size parameter and goes to every task once; each
    row is encoded where it is.
    """
    codes = texts.sparkSession.sparkContext.broadcast({r["word"]: r["code"] for r in dictionary.collect()})
    unknown = schemas.UNKNOWN_CODE

    def encode(fitting: pa.Array) -> pa.Array:
        known = codes.value
        return pa.array([[known.get(w, unknown) for w in row or ()] for row in fitting.to_pylist()], pa.list_(pa.int32()))

    fitting = F.slice(words(F.col(text)), 1, schemas.REVIEW_LENGTH - 1)
    return texts.withColumn("codes", padded_codes(F.arrow_udf(encode, "array<int>")(fitting)))


# Fixed value: the text of a rating.
def rating_line(review: Column, rating: Column) -> Column:
    return F.format_string('Sentiment rating for review "%s" is %.2f', review, rating)


# --- Tumour labels -----------------------------------------------------------

# The words and widths of a verdict line.

def match_line(actual: Column, predicted: Column, probabilities: list[Column]) -> Column:
    """``Match:``/``Miss:`` line; two unknown labels count as a match."""
    verdict = F.when(actual.eqNullSafe(predicted), F.lit("Match")).otherwise(F.lit("Miss"))
    return F.concat(
        verdict, F.lit(": Actual: "), left_aligned(actual, 15), F.lit("Prediction: "),
        left_aligned(predicted, 20), *[left_aligned(p, 25) for p in probabilities],
    )


def match_diagnoses(scored: DataFrame) -> DataFrame:
    """Compare ``diagnosis`` with ``predicted`` (letters) given ``probabilities``."""
    actual, predicted = tumour_type(F.col("diagnosis")), tumour_type(F.col("predicted"))
    chances = [F.col("probabilities")[i] for i in range(2)]
    return scored.withColumn("matched", actual.eqNullSafe(predicted)).withColumn(
        "line", match_line(actual, predicted, chances))


def match_rate(matches: DataFrame) -> DataFrame:
    """Share of rows whose prediction matched."""
    return matches.agg(F.avg(F.col("matched").cast("double")).alias("accuracy"))


def train_boosted_trees(train: DataFrame, features: list[str], label: str, trees: int = 100,
                        depth: int = 4, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Binary gradient-boosted trees with the established settings as defaults."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed),
    ]).fit(train)


def score_binary(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` and ``probabilities`` (two values)."""
    scored = model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
    return scored.drop("features", "rawPrediction", "probability")


def train_text_classifier(texts: DataFrame, text: str, label: str, features: int = 2 ** 14,
                          iterations: int = 40) -> PipelineModel:
    """Hashed word counts, weighted by rarity, into a logistic regression."""
    tokens = texts.withColumn("tokens", words(F.col(text)))
    return Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol=label, maxIter=iterations, regParam=0.01),
    ]).fit(tokens)


def classify_texts(texts: DataFrame, text: str, model: PipelineModel) -> DataFrame:
    scored = model.transform(texts.withColumn("tokens", words(F.col(text))))
    return scored.withColumn("probabilities", vector_to_array("probability")).drop(
        "tokens", "tf", "features", "rawPrediction", "probability")


# --- Image classes -----------------------------------------------------------

def class_centroids(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """The model: (label, centre) with the mean vector of each class."""
    means = vectors.groupBy(label).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("mean"))
    return means.select(F.col(label).alias("label"), vector_to_array("mean").alias("centre"))


def nearest_class(vectors: DataFrame, key: str, vector: str, centroids: DataFrame,
                  piece_vectors: int = PIECE_VECTORS, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """(key, predicted, distance): the class with the smallest squared distance, ties to the smaller label.

    Blocks of classes meet pieces of vectors, each pair in a group of bounded size, as one
    matrix product; the best of the blocks wins. ``key`` tells the rows apart.
    """
    blocks = max(1, -(-centroids.count() // block_classes))
    pieces = max(1, -(-vectors.count() // piece_vectors))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = vectors.select(
        F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int").alias("piece"), every(blocks).alias("block"))
    model = centroids.select(
        F.col("label").cast("long").alias("label"), "centre",
        F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"), every(pieces).alias("piece"))
    key_type = vectors.schema[key].dataType.simpleString()

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def compare(rows: pa.Table, classes: pa.Table) -> pa.Table:
        if not rows.num_rows or not classes.num_rows:
            return pa.table({"key": rows["key"].slice(0, 0), "distance": pa.array([], pa.float64()),
                             "predicted": pa.array([], pa.int64())})
        order = np.argsort(classes["label"].to_numpy())
        centres, labels = matrix(classes["centre"])[order], classes["label"].to_numpy()[order]
        best, found = [], matrix(rows["vector"])
        for at in range(0, len(found), 1024):
            part = found[at:at + 1024]
            rough = (centres ** 2).sum(1)[None, :] - 2 * part @ centres.T
            nearest = rough.argmin(1)
            best.append((((part - centres[nearest]) ** 2).sum(1), labels[nearest]))
        distance, predicted = (np.concatenate(x) for x in zip(*best))
        return pa.table({"key": rows["key"], "distance": distance, "predicted": predicted})

    groups = ["block", "piece"]
    found = dealt.groupBy(*groups).cogroup(model.groupBy(*groups)).applyInArrow(
        compare, f"key {key_type}, distance double, predicted long")
    return found.groupBy(F.col("key").alias(key)).agg(
        F.min_by("predicted", F.struct("distance", "predicted")).alias("predicted"), F.min("distance").alias("distance"))
