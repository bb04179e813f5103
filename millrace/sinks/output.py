"""Text files, logs, topics, fan-out and row counts in passing."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from millrace.sinks.keyed import BatchWriter


def write_lines(df: DataFrame, path: str, line: str = "value", mode: str = "overwrite",
                compression: str = "none", file_rows: int = 0) -> None:
    """Text files of the lines. Packed files cannot be split by a reader: ``file_rows`` bounds their lines."""
    lines = df.select(F.col(line).alias("value"))
    lines.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", file_rows).text(path)


def line_files(path: str, line: str = "line", shards: int | None = None) -> BatchWriter:
    """Text files per batch. ``shards`` bounds their number: 1 gives one file and
    suits small batches only; by default every task writes its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch if shards is None else batch.repartition(shards)
        write_lines(out, f"{path}/batch={batch_id}", line)

    return write


def windowed_line_files(path: str, line: str, window_start: Column, shards: int | None = None) -> BatchWriter:
    """Text files per batch, each of a range of windows; a line is its window, a tab and the text.

    The number of files follows the bytes, or ``shards``, and not the number of windows:
    fine windows would make a folder each. Lines of a window lie together, but a window
    of any size may go on in the next file.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(window_start.cast("string").alias("window"), F.col(line).alias("line"))
        order = ["window", "line"]
        spread = rows.repartitionByRange(*order) if shards is None else rows.repartitionByRange(shards, *order)
        lines = spread.sortWithinPartitions(*order).select(F.concat_ws("\t", "window", "line").alias("value"))
        lines.write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write


def read_windowed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(window, line) of all batches of ``windowed_line_files``."""
    cut = F.instr("value", "\t")
    return spark.read.text(path).select(
        F.substring("value", 1, cut - 1).alias("window"), F.substr("value", cut + 1).alias("line"))


def log_rows(df: DataFrame, line: str, logger: str = "millrace") -> None:
    """Log a formatted column where the rows are, as the workers' log."""

    def log(rows: Iterable[Row]) -> None:
        out = logging.getLogger(logger)
        for row in rows:
            out.info(row[0])

    df.select(line).foreachPartition(log)


def publish(df: DataFrame, connect: Callable[[], Any], send: Callable[[Any, str], None], line: str) -> None:
    """Send a text column to a topic, with one client per task."""

    def run(rows: Iterable[Row]) -> None:
        client = connect()
        for row in rows:
            send(client, row[0])

    df.select(line).foreachPartition(run)


def publish_to_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """Write (key, value) texts to a Kafka topic; needs the Kafka connector."""
    (df.select(F.col("key").cast("string"), F.col("value").cast("string"))
     .write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def fan_out(*writers: BatchWriter) -> BatchWriter:
    """Hand each batch to several writers, computing it once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for writer in writers:
                writer(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def peek(df: DataFrame, name: str) -> DataFrame:
    """Report the number of rows passing, without another job."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
