"""A topic in a folder, written by a sink of the data source API.

Tasks write their lines to part files with fresh names. The commit of a batch writes one
manifest that names its parts, and only named parts are read. A batch that runs again
finds its manifest and names nothing new, so every line is there once; parts of tasks and
batches that failed are named by none.

The folder is a path that driver and tasks share, or an address that pyarrow can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FORMAT = "millrace_topic"

MANIFEST = "source string, batch long, part string, lines long"


@dataclass
class Part(WriterCommitMessage):
    """What a task tells the commit: its file (None: it had no lines) and its lines."""

    name: str | None
    lines: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):  # Spark's form of a local address
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class TopicWriter(DataSourceStreamArrowWriter):
    """Writes the one text column of each batch to a topic."""

    def __init__(self, path: str, source: str):
        self.path, self.source = path, source

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = _open(self.path)
        name, out, lines = f"{uuid.uuid4().hex}.txt", None, 0
        try:
            for batch in iterator:
                values = batch.column(0).drop_null().to_pylist()
                if any("\n" in v for v in values):
                    raise ValueError("a line of a topic holds a line break")
                if values and out is None:
                    store.create_dir(f"{root}/parts", recursive=True)
                    out = store.open_output_stream(f"{root}/parts/{name}")
                if values:
                    out.write("".join(f"{v}\n" for v in values).encode())
                    lines += len(values)
        finally:
            if out is not None:
                out.close()
        return Part(name if lines else None, lines)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        store, root = _open(self.path)
        manifest = f"{root}/manifests/{self.source}-{batchId:020d}.json"
        if store.get_file_info(manifest).type != fs.FileType.NotFound:
            return  # the batch was there before a restart
        rows = [{"source": self.source, "batch": batchId, "part": m.name, "lines": m.lines} for m in messages if m and m.name]
        started = f"{root}/started/{uuid.uuid4().hex}"
        for folder in ("parts", "manifests", "started"):
            store.create_dir(f"{root}/{folder}", recursive=True)
        with store.open_output_stream(started) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        store.move(started, manifest)  # whole or not at all

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        """Nothing to undo: no manifest names the parts."""


class Topic(DataSource):
    """The sink ``millrace_topic``: options ``path`` and ``source``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options["path"], self.options["source"])


def write_topic(stream: DataFrame, path: str, checkpoint: str, source: str, line: str = "value") -> StreamingQuery:
    """Send a text column to the topic: what is there now, each line once.

    ``source`` names the stream within the topic; a stream that starts with a new
    checkpoint needs a new name. Null lines are left out; a line break inside a line is
    an error.
    """
    stream.sparkSession.dataSource.register(Topic)
    lines = stream.select(F.col(line).cast("string").alias("value"))
    return (lines.writeStream.format(FORMAT).option("path", path).option("source", source)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """(source, batch, value) of all lines that a finished batch named."""
    named = spark.read.schema(MANIFEST).json(f"{path}/manifests").drop("lines")
    lines = spark.read.option("lineSep", "\n").text(f"{path}/parts").select(
        "value", F.col("_metadata.file_name").alias("part"))
    return lines.join(named, "part").select("source", "batch", "value")
