"""Start streaming queries, each with its own checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.sinks.keyed import BatchWriter


def start(stream: DataFrame, writer: BatchWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand every batch to ``writer``: once through what is there, or ``every`` interval."""
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return query.trigger(**trigger).start()


def run_through(stream: DataFrame, writer: BatchWriter, checkpoint: str) -> None:
    """Process what is there and wait for the end."""
    start(stream, writer, checkpoint).awaitTermination()


def to_console(stream: DataFrame, line: str, checkpoint: str, every: str) -> StreamingQuery:
    """Print a formatted column as it arrives."""
    return (stream.select(line).writeStream.format("console").option("truncate", False)
            .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())
