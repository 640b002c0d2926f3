"""An entity's timeline as one stateful processor: snapshots at fixed times and the first crossing of a threshold, in event time.

States may come out of order. An entity's are held until the watermark passes the end of their interval; then a timer, one for all
intervals that the watermark has passed, puts out the interval's snapshot (the last value in it and how many there were) and, once, the time at which the value first exceeded the
threshold. So what is put out is final and doesn't depend on the order of arrival, on batches or on restarts. State is the states of
open intervals and three numbers; an entity that is idle for some intervals is forgotten. ``flush_row`` ends a stream: its time
is later than any other, so all timers fire.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "entity long, kind string, time_ms long, value double, n long"
FLUSH_ENTITY, FLUSH_TIME = -(1 << 63), datetime(2200, 1, 1)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["entity", "kind", "time_ms", "value", "n"]).astype({"kind": object})


class Timeline(StatefulProcessor):
    def __init__(self, interval_ms: int, above: float, idle: int | None = None):
        self.interval, self.above, self.idle = interval_ms, above, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "time_ms long, value double")
        self.known = handle.getValueState("known", "highest double, crossed boolean, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            end = int(some["time_ms"].min() // self.interval + 1) * self.interval
            first = end if first is None else min(first, end)
            self.held.appendList(list(zip(some["time_ms"].tolist(), some["value"].tolist(), strict=True)))
        if first is not None and not any(t <= first for t in self.handle.listTimers()):
            self.handle.registerTimer(first)  # one that stands for all later intervals too
        yield _rows([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All intervals that the watermark has passed, with one look at the state."""
        passed, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        slots: dict[int, list[tuple]] = {}
        for t, v in sorted((t, v) for t, v in self.held.get()):
            slots.setdefault((t // self.interval + 1) * self.interval, []).append((t, v))
        due, later = {e: h for e, h in slots.items() if e <= passed}, {e: h for e, h in slots.items() if e > passed}
        highest, crossed, last = self.known.get() if self.known.exists() else (float("-inf"), False, None)
        for now, states in due.items():  # in order of time
            if self.idle is not None and last is not None and states[0][0] // self.interval - last // self.interval > self.idle:
                highest, crossed = float("-inf"), False  # forgotten, whether or not the timer that clears its state has fired yet
            for time, value in states:
                highest = max(highest, value)
                if value > self.above and not crossed:
                    crossed = True
                    out.append((key[0], "crossing", time, highest, 1))
            last = states[-1][0]
            out.append((key[0], "snapshot", now, states[-1][1], len(states)))
        if due:
            if later:
                self.held.put([h for states in later.values() for h in states])
            else:
                self.held.clear()
        if later:
            self.handle.registerTimer(min(later))
        forgotten = None if self.idle is None or last is None else (last // self.interval + 1 + self.idle) * self.interval
        if forgotten is not None and not later and passed >= forgotten:
            self.known.clear()  # nothing came for so long
        elif due:
            self.known.update((highest, crossed, last))
            if forgotten is not None:
                self.handle.registerTimer(forgotten)
        yield _rows(out)

    def close(self) -> None:
        pass


def timeline(states: DataFrame, entity: str, time: str, value: str, interval_ms: int, above: float, delay: str = "0 seconds", idle: int | None = None) -> DataFrame:
    """(entity, kind, time_ms, value, n) of a stream: a ``snapshot`` for each entity and interval with states (time_ms is the interval's end, value
    the last in it, n how many), and a ``crossing`` once (time_ms is its time, value the highest until then). Rows later than the
    watermark are dropped; with ``idle`` an entity is forgotten after so many intervals without states, and may cross again."""
    rows = states.select(F.col(entity).cast("long").alias("entity"), F.col(time).alias("time"), F.unix_millis(F.col(time)).alias("time_ms"), F.col(value).cast("double").alias("value"))
    grouped = rows.where("time IS NOT NULL AND value IS NOT NULL").withWatermark("time", delay).groupBy("entity")
    return grouped.transformWithStateInPandas(Timeline(interval_ms, above, idle), OUTPUT, "append", "EventTime")


def flush_row(states: DataFrame, entity: str, time: str) -> DataFrame:
    """One row of the shape of ``states`` that makes all timers fire when it is put into the stream last."""
    spark = states.sparkSession
    row = spark.range(1).select(*(F.lit(FLUSH_ENTITY).cast(f.dataType).alias(f.name) if f.name == entity else F.lit(FLUSH_TIME).cast(f.dataType).alias(f.name) if f.name == time else F.lit(0).cast(f.dataType).alias(f.name) for f in states.schema.fields))
    return row


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB state store: the session has it inside, and what it had before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)
