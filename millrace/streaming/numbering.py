"""Running row numbers over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators.ordered import number_rows
from millrace.sinks.keyed import BatchWriter


def numbered(writer: BatchWriter, path: str, order: list, name: str) -> BatchWriter:
    """Number each batch in order, from where the batches before it ended.

    The rows so far are stored per batch under ``path``, and a batch reads the one row
    before its own; a repeated batch replaces its own row and starts from the same
    number again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        offset = 0
        if batch_id:
            offset = spark.read.parquet(f"{path}/batch={batch_id - 1}").first()[0]
        rows = number_rows(batch, order, name)
        rows.agg((F.count("*") + offset).alias("upto")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        writer(rows.withColumn(name, F.col(name) + offset), batch_id)

    return write
