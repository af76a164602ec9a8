"""Keyed schedulers: streams of outcomes in, logs of dispatches out, each key with its own state and event-time timers.

What came for a key and is not yet passed by the watermark waits in a list, because rows come in any order within the watermark's delay; timers
fire at the moment the next of them, or the next thing due, is passed. So the log is the same whatever the order and the batches of the rows.
What a key does is told by a machine:

- `Polls`, for sources that are polled for ever (`once=False`) and jobs that end (`once=True`). After a success a key falls due one interval later.
  After a failure it is tried again `retry` seconds later, twice as long each time, while retries are left; then an interval later, or `slow` (6)
  intervals from the `slow_after`th (5th) failure in a row on. An outcome locks its key for `ttl` seconds, within which nothing is dispatched. A
  dispatch that no outcome answers is repeated an interval later. A job leaves the queue when it succeeds or after `max_attempts` (3) failures.
- `Chains`, for work that starts itself again: a beat starts a chain unless one holds the lock; a batch that attempted something renews the lock
  for `ttl` seconds, one that attempted nothing ends the chain, and a chain that falls silent loses its lock by time, so that the next beat starts it.

State lives in RocksDB, as transformWithState needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How many intervals a failing source waits, from which failure in a row on, and how often a body is tried.
SLOW, SLOW_AFTER, MAX_ATTEMPTS = 6, 5, 3
#: Time in micros, what happened, and a count: of failures in a row, or of a chain's batches.
Row = tuple[int, str, int]
BEAT = -1
_SECOND = 1_000_000


@dataclass(frozen=True)
class Polls:
    """Times in seconds. The values of rows: 1 for a success, 0 for a failure. Log: poll, retry, done, left."""

    interval: int
    retry: int = 0
    retries: int = 0
    ttl: int = 0
    once: bool = False
    slow: int = SLOW
    slow_after: int = SLOW_AFTER
    max_attempts: int = MAX_ATTEMPTS

    def wait(self, failures: int) -> int:
        return self.interval * (self.slow if failures >= self.slow_after else 1) * _SECOND

    def run(self, state: tuple, rows: list[tuple[int, int]], until: int) -> tuple[tuple, list[Row]]:
        """What happens before `until`, in order of time; state: next due time or none, failures, whether the key has left."""
        due, failures, gone = state
        log: list[Row] = []
        for at, value in [*sorted(rows), (until, None)]:
            while due is not None and due < at:
                log.append((due, "retry" if 0 < failures <= self.retries else "poll", failures))
                due += self.wait(failures)
            if value is None or gone:
                continue
            failures = 0 if value > 0 else failures + 1
            if self.once and (value > 0 or failures >= self.max_attempts):
                gone, due = 1, None
                log.append((at, "done" if value > 0 else "left", failures))
                continue
            wait = (self.retry << (failures - 1)) * _SECOND if 0 < failures <= self.retries else self.wait(failures)
            due = at + max(wait, self.ttl * _SECOND)
        return (due, failures, gone), log


@dataclass(frozen=True)
class Chains:
    """Times in seconds. The values of rows: BEAT, or how many a batch attempted. Log: started, refused, continued, ended, expired."""

    ttl: int

    def run(self, state: tuple, rows: list[tuple[int, int]], until: int) -> tuple[tuple, list[Row]]:
        """state: until when the lock holds or none, batches of the chain."""
        lock, batches, _ = state
        log: list[Row] = []
        for at, value in [*sorted(rows), (until, None)]:
            if lock is not None and (lock < at or lock == at and value is not None):
                log.append((lock, "expired", batches))
                lock = None
            if value is None:
                continue
            if value == BEAT and lock is None:
                lock, batches = at + self.ttl * _SECOND, 0
                log.append((at, "started", 0))
            elif value == BEAT:
                log.append((at, "refused", batches))
            elif lock is not None:
                batches += 1
                lock = at + self.ttl * _SECOND if value > 0 else None
                log.append((at, "continued" if value > 0 else "ended", batches))
        return (lock, batches, 0), log


class Scheduler(StatefulProcessor):
    def __init__(self, machine: Polls | Chains, horizon: int | None):
        self.machine, self.horizon = machine, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next long, n int, gone int")
        self.waiting = handle.getListState("waiting", "at long, value long")

    def _advance(self, key: str, watermark_ms: int) -> Iterator[pd.DataFrame]:
        until = watermark_ms * 1000
        waiting = [(int(r[0]), int(r[1])) for r in self.waiting.get()] if self.waiting.exists() else []
        rest = [r for r in waiting if r[0] >= until]
        stop = until if self.horizon is None else min(until, self.horizon)
        state, log = self.machine.run(tuple(self.state.get()) if self.state.exists() else (None, 0, 0), [r for r in waiting if r[0] < stop], stop)
        self.state.update(state)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [at for at, _ in rest] + ([state[0]] if state[0] is not None else [])
        times = [t for t in times if self.horizon is None or t < self.horizon]
        if times:
            self.handle.registerTimer(max(min(times) // 1000, watermark_ms) + 1)
        if log:
            yield pd.DataFrame({"key": [key] * len(log), "micros": [at for at, _, _ in log], "what": [w for _, w, _ in log], "n": pd.array([n for _, _, n in log], dtype="int32")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gone = self.state.exists() and self.state.get()[2]
        new = [(int(at), int(v)) for f in rows for at, v in zip(f["micros"], f["value"])]
        if not gone and new:
            self.waiting.appendList(new)
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def schedule(rows: DataFrame, machine: Polls | Chains, delay: str = "0 seconds", horizon: int | None = None) -> DataFrame:
    """(key, at, what, n) of a stream of rows (key, at, value). Rows without key or time are dropped, as are those later than the delay.

    horizon: micros of event time; nothing at or beyond it is told.
    """
    at = F.col("at").cast("timestamp")
    timed = rows.filter("key is not null and at is not null").select(F.col("key").cast("string").alias("key"), at.alias("at"), F.unix_micros(at).alias("micros"), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value"))
    log = timed.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(Scheduler(machine, horizon), "key string, micros long, what string, n int", "Append", "EventTime")
    return log.select("key", F.timestamp_micros("micros").alias("at"), "what", "n")
