"""Keyed table and journal on plain files.

A keyed table keeps, in its folder,

* ``batches/batch=N``: the last row per key of batch N; a repeated batch replaces
  its own folder;
* ``bases/upto=N``: the whole table after batch N, made by ``compact``, in folders of key
  buckets, each in ranges of its keys;
* ``pointer``: one row per finished base, with its number of buckets.

Readers take the newest finished base and the batches after it. A base is named in
the pointer only once it is written, and batches keep their numbers and their place,
so a stream writes on while the table is compacted. A lookup of some keys reads only
their buckets of the base, and of files sorted by key only the parts that can hold them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.prices import latest_by_key

BatchWriter = Callable[[DataFrame, int], None]

#: Buckets of a base. Each holds this share of the keys, whatever their rows were.
BUCKETS = 64


def append_batch(path: str) -> BatchWriter:
    """Keep all rows of every batch. For tables read whole; followers need ``write_journal``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of ``append_batch``, with their ``batch`` number."""
    return spark.read.parquet(path)


def write_journal(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep all changes of a stream, each once: the file sink logs the files of a batch,
    and a repeated batch adds none."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All changes of a journal."""
    return spark.read.parquet(path)


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """The changes of a journal from the oldest, as a stream; only logged files are read."""
    return spark.readStream.schema(read_journal(spark, path).schema).parquet(path)


def upsert(path: str, keys: list[str], order: list[str]) -> BatchWriter:
    """Keep the last row per key; only that row per key and batch is stored."""
    write_rows = append_batch(f"{path}/batches")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_rows(latest_by_key(batch, keys, order), batch_id)

    return write


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _base(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The batch up to which the newest finished base goes, and its buckets."""
    try:
        return spark.read.parquet(f"{path}/pointer").agg(F.max(F.struct("upto", "buckets")).alias("p")).select("p.*").first()
    except AnalysisException:  # never compacted
        return None


def _stored(spark: SparkSession, path: str, keys: list[str] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Base and later batches; with ``wanted`` only the buckets of its keys."""
    batches = spark.read.parquet(f"{path}/batches")
    newest = _base(spark, path)
    if newest is None:
        return batches
    upto, buckets = newest
    base = spark.read.parquet(f"{path}/bases/upto={upto}")
    if wanted is not None:
        asked = wanted.select(_bucket(keys, buckets).alias("bucket")).distinct().collect()  # as many as there are buckets
        base = base.where(F.col("bucket").isin([r["bucket"] for r in asked]))
    base = base.drop("bucket").withColumn("batch", F.lit(upto).cast(batches.schema["batch"].dataType))
    return batches.where(F.col("batch") > upto).unionByName(base)


def read_latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table as of now; on equal order the later batch wins."""
    return latest_by_key(_stored(spark, path), keys, [*order, "batch"]).drop("batch")


def read_keys(spark: SparkSession, path: str, keys: list[str], order: list[str], wanted: DataFrame) -> DataFrame:
    """The table's rows as of now for the keys in ``wanted``; null keys have none."""
    asked = wanted.select(*keys).dropna().distinct()
    found = _stored(spark, path, keys, asked).join(asked, keys, "left_semi")
    return latest_by_key(found, keys, [*order, "batch"]).drop("batch")


def read_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The rows stored by the batches before ``batch_id``; None if there are none."""
    try:
        return _stored(spark, path).where(F.col("batch") < batch_id)
    except AnalysisException:  # nothing written yet
        return None


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """Fold all batches so far into a new base. Run by one process at a time."""
    upto = _stored(spark, path).agg(F.max("batch")).first()[0]
    newest = _base(spark, path)
    if upto is None or (newest is not None and upto == newest[0]):
        return
    stored = _stored(spark, path).where(F.col("batch") <= upto)
    latest = latest_by_key(stored, keys, [*order, "batch"]).drop("batch").withColumn("bucket", _bucket(keys, buckets))
    place = ["bucket", *keys]
    ranged = latest.repartitionByRange(*place).sortWithinPartitions(*place)
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bases/upto={upto}")
    spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(buckets).alias("buckets")).write.mode("append").parquet(
        f"{path}/pointer")
