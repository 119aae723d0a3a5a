"""Recurrence of every failure, kept as state per key with event-time timers.

An event at t waits until the watermark has passed it, so that everything before t is known, and then learns how many failures of
its (dag, task, category) lie in [t - days, t).  A key's failures are dealt to a grid of ``spread`` x ``spread`` sub-keys: an event asks in
one row of the grid and is remembered in one column, so each pair of events meets in exactly one sub-key, and a
sub-key of a hot key holds a ``spread``-th of its asks and of its memory.  The counts of an event's row are added up when the
written partial counts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

KEYS = ["dag_id", "task_id", "error_category"]
DAY_US = 86_400_000_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEPARATOR = "\x1f"


class _Recurrence(StatefulProcessor):
    """State of a sub-key: the instants remembered, the asks that still wait (instants and ids), and the timer that is set."""

    def __init__(self, days: int):
        self.span = days * DAY_US

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recurrence", "seen binary, due binary, ids string, timer bigint")

    def _load(self) -> tuple[np.ndarray, np.ndarray, list[str], int]:
        if not self.state.exists():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        seen, due, ids, timer = self.state.get()
        due = np.frombuffer(bytes(due), np.int64)
        return np.frombuffer(bytes(seen), np.int64), due, ids.split(SEPARATOR) if len(due) else [], timer

    def _store(self, seen: np.ndarray, due: np.ndarray, ids: list[str], timer: int) -> None:
        # A timer just behind the earliest ask; an earlier one that is set already will set the next.
        if len(due) and (not timer or int(due.min()) // 1000 + 1 < timer):
            timer = int(due.min()) // 1000 + 1
            self.handle.registerTimer(timer)
        self.state.update((seen.tobytes(), due.tobytes(), SEPARATOR.join(ids), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, due, ids, timer = self._load()
        for part in rows:
            at, asks, kept = part["at_us"].to_numpy(np.int64), part["asks"].to_numpy(bool), part["kept"].to_numpy(bool)
            seen, due = np.r_[seen, at[kept]], np.r_[due, at[asks]]
            ids = ids + part["event_key"][asks].tolist()
        self._store(np.sort(seen), due, ids, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        seen, due, ids, timer = self._load()
        # Timers that fire together find the asks answered by the first.
        ready = due < passed
        now, names = due[ready], [i for i, r in zip(ids, ready, strict=True) if r]
        counts = np.searchsorted(seen, now, "left") - np.searchsorted(seen, now - self.span, "left")
        waiting = due[~ready]
        oldest = int(waiting.min()) if len(waiting) else passed
        self._store(seen[np.searchsorted(seen, min(oldest, passed) - self.span, "left"):], waiting,
                    [i for i, r in zip(ids, ready, strict=True) if not r], 0)
        if len(now):
            yield pd.DataFrame({"event_key": names, "at_us": now, "partial": counts.astype(np.int64)})

    def close(self) -> None:
        pass


def recurrence_partials(events: DataFrame, key: str = "event_id", days: int = 30, delay: str = "1 hour", spread: int = 2) -> DataFrame:
    """(event_key, at_us, partial): ``spread`` rows for each event, once the watermark has passed it.

    ``key`` tells events apart; an event without time or later than ``delay`` is not counted.  Null keys are values of their own.
    """
    code = F.xxhash64(key)
    row, column = F.pmod(code, F.lit(spread)), F.pmod(F.shiftright(code, 32), F.lit(spread))
    cells = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(spread * spread - 1)), lambda i: F.struct(
            i.alias("cell"), (F.floor(i / spread) == row).alias("asks"), (i % spread == column).alias("kept"))),
        lambda c: c["asks"] | c["kept"])
    dealt = events.where("failed_at IS NOT NULL").withWatermark("failed_at", delay).select(
        *[F.coalesce(F.col(k), F.lit("\x1e")).alias(k) for k in KEYS], "failed_at", F.unix_micros("failed_at").alias("at_us"),
        F.col(key).cast("string").alias("event_key"), F.explode(cells).alias("c")).select(
        *KEYS, "failed_at", "at_us", "event_key", "c.*")
    return dealt.groupBy(*KEYS, "cell").transformWithStateInPandas(
        _Recurrence(days), "event_key string, at_us bigint, partial bigint", "Append", "EventTime")


def run_recurrence(partials: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the partial counts to ``path``.  The state lives in the RocksDB store, which timers need."""
    spark = partials.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        writer = partials.writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", checkpoint).option("path", path)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def recurrence_counts(partials: DataFrame, spread: int = 2) -> DataFrame:
    """(event_key, at_us, recurrence_30d) of the events whose counts are complete."""
    return partials.groupBy("event_key", "at_us").agg(
        F.sum("partial").alias("recurrence_30d"), F.count("*").alias("_n")).where(F.col("_n") == spread).drop("_n")
