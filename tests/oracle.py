"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
          "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT"}


def compare(spark, folder: str, build, sql: str) -> tuple[int, str]:
    """Row count and a text saying how the results differ ('' if they do not)."""
    frame = build(spark, folder)
    types = dict(frame.dtypes)
    names = sorted(types)
    ours = sorted(tuple(_plain(row[n]) for n in names) for row in frame.collect())
    relation = connect(folder).execute(sql)
    header = {d[0]: str(d[1]) for d in relation.description}
    if sorted(header) != names:
        return len(ours), f"columns {names} against {sorted(header)}"
    wrong = [f"{n}: {types[n]} against {header[n]}" for n in names if _TYPES.get(types[n]) != header[n]]
    place = [list(header).index(n) for n in names]
    theirs = sorted(tuple(_plain(row[p]) for p in place) for row in relation.fetchall())
    if wrong:
        return len(ours), "types " + "; ".join(wrong)
    if len(ours) != len(theirs):
        missing = set(theirs) - set(ours)
        return len(ours), f"{len(ours)} rows against {len(theirs)}, e.g. missing {list(missing)[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return len(ours), f"{names}: {len(bad)} rows differ, first {bad[:2]}" if bad else ""
