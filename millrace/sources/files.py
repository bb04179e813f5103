"""File readers, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import schemas
from millrace.functions.records import parse_event
from millrace.functions.text import unquoted
from millrace.operators.prices import latest_by_key
from millrace.operators.topics import mentioning


def lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Every line of every file as ``value``."""
    return spark.read.option("pathGlobFilter", glob).text(folder)


def car_counts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """CSV lines ``time,location,count`` without a header; a malformed line fails the job."""
    return (spark.read.schema(schemas.CAR_COUNT).option("mode", "FAILFAST").option("pathGlobFilter", glob)
            .csv(folder))


def tumours(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, 32 columns by position, the label quoted; a malformed line fails the job."""
    rows = spark.read.option("header", True).option("mode", "FAILFAST").schema(schemas.TUMOUR).csv(path)
    return rows.withColumn("diagnosis", unquoted(F.col("diagnosis")))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Race events from JSON lines; of equal names the last line wins.

    Lines have no number of their own, so file name and place in the file decide.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"))
    parsed = raw.select(parse_event(F.col("value")).alias("e"), "_file", "_block", "_place")
    flat = parsed.where(F.col("e.name").isNotNull()).select("e.*", "_file", "_block", "_place")
    return latest_by_key(flat, ["name"], ["_file", "_block", "_place"]).drop("_file", "_block", "_place")


def word_index(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Dictionary rows (word, code) from JSON maps, one per file or one per line;
    codes move up past the reserved ones."""
    raw = spark.read.text(path, wholetext=whole_files)
    entries = F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "code")
    return raw.select(entries).select("word", (F.col("code") + schemas.RESERVED_CODES).alias("code"))


def images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Image files with path, time and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def sample_reviews(spark: SparkSession) -> DataFrame:
    """Five short reviews to try a model on, keys 0 to 4."""
    texts = [
        "a fine evening, well played",
        "we left before the end",
        "simply the best songs of the year",
        "dull, loud and far too long",
        "strong first half, weak second, lovely pictures all the same",
    ]
    return spark.createDataFrame(list(enumerate(texts)), "key long, text string")


def line_stream(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """Lines of files as they are added. Land files whole."""
    reader = spark.readStream.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def table_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of one schema as a stream."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def tracked_posts(posts: DataFrame, raw: str = "value",
                  markers: dict[str, list[str]] = schemas.COIN_MARKERS) -> DataFrame:
    """Posts (JSON with ``text``) that mention any of the tracked terms."""
    return mentioning(posts.withColumn("text", F.get_json_object(raw, "$.text")), "text", markers)
