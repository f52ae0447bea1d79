"""Streams with state of their own, by Spark's stateful processors.

State lies in Spark's state store, a value or a map per key, and is let go by timers on event time. A time to live would go by
processing time, and a stream that has any never ends under ``availableNow``.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Map state and timers need this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A source without a run for so many days is forgotten.
STREAK_DAYS = 400
DAY_MS = 86_400_000


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """The state store for stateful processors, for the queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Slots(StatefulProcessor):
    """Attempts of a (source, day) slot: how many there were, and how many stored all or a part. A timer closes the slot."""

    def __init__(self, attempts: int, horizon_days: int):
        self.attempts, self.horizon = attempts, horizon_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "attempts long, stored long, parts long")

    def _row(self, key: tuple, attempts: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "day": [key[1]], "attempts": [attempts], "status": [status]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.get() if self.seen.exists() else (0, 0, 0)
        attempts, stored, parts = map(int, known)
        for pdf in rows:
            attempts, stored, parts = attempts + len(pdf), stored + int((pdf["value"] > 95).sum()), parts + int((pdf["value"] > 90).sum())
        if known[0] == 0:
            end = int(pd.Timestamp(key[1]).timestamp() * 1000) + (1 + self.horizon) * DAY_MS
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        self.seen.update((attempts, stored, parts))
        yield self._row(key, attempts, "complete" if stored else "partial" if parts else "failed" if attempts >= self.attempts else "queued")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, stored, _ = map(int, self.seen.get())
        self.seen.clear()
        if not stored:
            yield self._row(key, attempts, "aged out")

    def close(self) -> None:
        pass


def slot_states(rows: DataFrame, attempts: int = jobs.ATTEMPTS, horizon_days: int = jobs.HORIZON_DAYS) -> DataFrame:
    """The state of every (source, day) slot of a stream ``rows (at, event_type, day, value)`` with a watermark, as it changes."""
    return rows.groupBy("event_type", "day").transformWithStateInPandas(Slots(attempts, horizon_days), "source string, day string, attempts long, status string", "Update", "EventTime")


class Streak(StatefulProcessor):
    """Zero runs behind the newest run that stored something; rows may come late, in any order and again.

    A map has the runs that stored nothing and are newer than the newest that did, by (time, id). A run that stored something drops
    those up to it; an older one of either kind changes nothing. So the state is as large as the streak, not as the history.
    """

    def __init__(self, days: int):
        self.silence = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, id long")
        self.due = handle.getValueState("due", "at long")
        self.zeros = handle.getMapState("zeros", "at long, id long", "one int")

    def _wait(self, newest_us: int, timerValues) -> None:
        """Moves the timer behind the newest run."""
        due = max(newest_us // 1000 + self.silence, timerValues.getCurrentWatermarkInMs() + 1)
        before = int(self.due.get()[0]) if self.due.exists() else None
        if before is None or due > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, self.due, self.zeros):
            state.clear()
        yield pd.DataFrame({"source": [key[0]], "streak": [0], "stored_ever": [False]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(map(int, self.last.get())) if self.last.exists() else (-(1 << 62), 0)
        fresh, newest, latest = set(), last, last[0]
        for pdf in rows:
            for at, number, entries in zip(pdf["at_us"].tolist(), pdf["id"].tolist(), pdf["entries"].tolist(), strict=True):
                if entries > 0:
                    newest = max(newest, (at, number))
                else:
                    fresh.add((at, number))
                latest = max(latest, at)
        self._wait(latest, timerValues)
        if newest > last:
            self.last.update(newest)
            for old in [tuple(map(int, k)) for k in self.zeros.keys()] if self.zeros.exists() else ():
                if old < newest:
                    self.zeros.removeKey(old)
        for run in fresh:
            if run > newest:
                self.zeros.updateValue(run, (1,))
        streak = sum(1 for _ in self.zeros.keys()) if self.zeros.exists() else 0
        yield pd.DataFrame({"source": [key[0]], "streak": [streak], "stored_ever": [newest[0] > -(1 << 62)]})

    def close(self) -> None:
        pass


def zero_streaks(rows: DataFrame, days: int = STREAK_DAYS) -> DataFrame:
    """How many of the newest runs of each source in a row stored nothing, as a stream of ``rows (source, at, id, entries)`` with a watermark goes on."""
    timed = rows.select("source", "at", F.unix_micros("at").alias("at_us"), "id", "entries")
    return timed.groupBy("source").transformWithStateInPandas(Streak(days), "source string, streak long, stored_ever boolean", "Update", "EventTime")


def streaks_of(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """The last streak of each source, after the whole telemetry went through the stream."""
    n = F.col("event_id")
    entries = F.when(n % 4 == 0, F.lit(0)).otherwise(F.floor("value")).cast("long")
    # Every seventh run is delivered twice.
    rows = jobs.source(spark, sf_dir, files).withWatermark("at", jobs.span(spark, sf_dir)).select(F.col("event_type").alias("source"), "at", n.alias("id"), entries.alias("entries"), F.explode(F.when(n % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    with rocks(spark):
        out = jobs.run(zero_streaks(rows.drop("copy")), "update")
    return jobs.newest(out, ["source"]).select("source", "streak", "stored_ever")
