"""Operators on keyed state: change notices, and windows that fire early and again.

Each keeps a few values per key in the state store; nothing stored by earlier batches is
read again. A key's rows pass one by one and are never held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.operators.prices import notice_line


class _Notices(StatefulProcessor):
    """ADDED for the first change of a key, UPDATED for all others."""

    def __init__(self, order: str, value: str):
        self.order, self.value = order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self.known.exists():
            for row in rows:
                yield Row(**row.asDict(), kind="UPDATED")
            return
        first = None
        for row in rows:  # only the first one so far is held back
            later = row
            if first is None or self._place(row) < self._place(first):
                first, later = row, first
            if later is not None:
                yield Row(**later.asDict(), kind="UPDATED")
        self.known.update((True,))
        yield Row(**first.asDict(), kind="ADDED")

    def _place(self, row: Row) -> tuple:
        return tuple((row[c] is not None, row[c]) for c in (self.order, self.value))

    def close(self) -> None:
        pass


def notices(changes: DataFrame, table: str, key: str, value: str, order: str) -> DataFrame:
    """A text per change of a stream, as ``prices.change_notices`` gives for a table.

    Whether a key was there before is one value in the state store. Of a key's first
    batch the change with the smallest order, then value, is ADDED. A NULL key is a key.
    """
    out = StructType([*changes.schema.fields]).add("kind", "string")
    marked = changes.groupBy(key).transformWithState(
        statefulProcessor=_Notices(order, value), outputStructType=out, outputMode="append", timeMode="none")
    return marked.withColumn("line", notice_line(table, F.col("kind"), key, value))


class _Panes(StatefulProcessor):
    """Sums of a window, given out some time after the first row since the last firing, then begun anew."""

    def __init__(self, keys: list[str], value: str, delay_ms: int):
        self.keys, self.value, self.delay_ms = keys, value, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "firing long, rows long, total double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        firing, count, total = self.held.get() if self.held.exists() else (0, 0, 0.0)
        if count == 0:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)
        for row in rows:
            count, total = count + 1, total + (row[self.value] or 0.0)
        self.held.update((firing, count, total))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        firing, count, total = self.held.get()
        self.held.update((firing + 1, 0, 0.0))
        yield Row(**dict(zip(self.keys, key, strict=True)), firing=firing, rows=count, total=total)

    def close(self) -> None:
        pass


def early_panes(rows: DataFrame, keys: list[str], value: str, delay_ms: int) -> DataFrame:
    """(keys, firing, rows, total): what each group has got since it last fired.

    A group fires ``delay_ms`` of processing time after the first row since its last
    firing, again and again, and gives only what is new: the firings of a group add up to
    its rows. ``keys`` may hold the start of a window. Run it with a trigger that goes on
    (``run.start`` with ``every``), so that timers are looked at when no rows come. Rows
    are summed one by one; sum them up before by any finer key where a group is hot.
    """
    out = StructType([rows.schema[k] for k in keys]).add("firing", "long").add("rows", "long").add("total", "double")
    return rows.select(*keys, value).groupBy(*keys).transformWithState(
        statefulProcessor=_Panes(keys, value, delay_ms), outputStructType=out, outputMode="update", timeMode="processingTime")
