"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings: event time is UTC, hot join keys are split at run time, state is
# kept outside the heap, and checkpoints are compressed.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the runtime settings; ``conf`` adds or overrides entries."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoint files go when nothing refers to them any more.
    start_conf = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.checkpoint.compress": "true"}
    for key, value in {**RUNTIME_CONF, **start_conf, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built.

    What its owner has set stays, but for the time zone, which the results depend on.
    """
    for key, value in RUNTIME_CONF.items():
        now = spark.conf.get(key, None)
        if now is None or (key == "spark.sql.session.timeZone" and now != value):
            spark.conf.set(key, value)
    return spark


#: Set, the shuffle files of a query go when it ends (Spark 4.1).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run meanwhile go as each ends, not when the driver next collects its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and scratch tables, shared by all executors.

    The cluster's own ``spark.checkpoint.dir`` wins. A temporary folder is made
    only in local mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if active:
        return named or active
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
