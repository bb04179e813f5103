"""The queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from millrace import session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(session.tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables kept since the innermost ``keep_only`` began; none outside of one.
_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def keep(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to a fresh table in the shared folder and read back.

    Cuts the lineage, so a lost executor costs a read and not the whole job, and
    gives the planner the true size. Shuffle files of the writing go when it ends.
    """
    spark = frame.sparkSession
    path = session.scratch_path(spark, name)
    with session.shuffles_removed(spark):
        frame.write.parquet(path)
    if (kept := _kept.get()) is not None:
        kept.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def keep_only(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, kept. The tables that it kept on the way are removed then: nothing else may read them."""
    outer = _kept.set([])
    try:
        frame = build()
        gone = _kept.get()
    finally:
        _kept.reset(outer)
    out = keep(frame, name)
    for path in gone:
        session.remove(frame.sparkSession, path)
    return out
