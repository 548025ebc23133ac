"""Login failures of a key as state: a success deletes them, and each leaves by a timer when its window has passed.

The stream's result is a log of changes (key, at, seq, n, oldest): how many failures count from that second on, and the
oldest of them. as_of() reads the log at any point in time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which arbitrary state needs; other streams are left as they were."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Failures:
    """What is known of one key: failures by second, the last success, the latest second seen and the number of changes told."""

    def __init__(self, window_s: int, seconds: list[int] = (), counts: list[int] = (), last_ok: int = -1, clock: int = -1, seq: int = 0) -> None:
        self.window_s, self.last_ok, self.clock, self.seq = window_s, last_ok, clock, seq
        self.live = dict(zip(seconds, counts, strict=True))  # in order of time
        self.changes: list[tuple[int, int, int, int | None]] = []

    def tell(self, at: int) -> None:
        self.changes.append((at, self.seq, sum(self.live.values()), min(self.live, default=None)))
        self.seq += 1

    def pass_time(self, now: int) -> None:
        """Drops what is too old at `now`, telling the second in which it was."""
        for second in sorted(s for s in self.live if s <= now - self.window_s):
            del self.live[second]
            self.tell(second + self.window_s)
        self.clock = max(self.clock, now)

    def see(self, at: int, failed: int, succeeded: bool) -> None:
        """All of one second; a success counts after the failures of its second. What comes late counts from now on."""
        self.pass_time(at)
        before = dict(self.live)
        if failed and at > self.last_ok and at > self.clock - self.window_s:
            self.live[at] = self.live.get(at, 0) + failed
        if succeeded:
            self.last_ok = max(self.last_ok, at)
            self.live = {s: n for s, n in self.live.items() if s > at}
        if self.live != before:
            self.tell(self.clock)

    def next_expiry(self) -> int:
        return min(self.live) + self.window_s if self.live else -1


class FailureProcessor(StatefulProcessor):
    """Keeps Failures of each key in one value, and one timer for the oldest of them."""

    def __init__(self, key: str, window_s: int) -> None:
        self.key, self.window_s = key, window_s

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "seconds array<bigint>, counts array<bigint>, last_ok bigint, clock bigint, seq bigint, timer bigint")

    def _load(self) -> tuple[Failures, int]:
        if not self.state.exists():
            return Failures(self.window_s), -1
        seconds, counts, last_ok, clock, seq, timer = self.state.get()
        return Failures(self.window_s, list(seconds), list(counts), last_ok, clock, seq), timer

    def _store(self, key, known: Failures, timer: int, fired: bool) -> Iterator[pd.DataFrame]:
        due = known.next_expiry()
        if due != timer or fired:
            if timer >= 0 and not fired:
                self.handle.deleteTimer(timer * 1000)
            if due >= 0:
                self.handle.registerTimer(due * 1000)
        seconds = sorted(known.live)
        self.state.update((seconds, [known.live[s] for s in seconds], known.last_ok, known.clock, known.seq, due))
        if known.changes:
            told = pd.DataFrame(known.changes, columns=["at", "seq", "n", "oldest"]).astype({"oldest": "Int64"})
            told.insert(0, self.key, key[0])
            yield told

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        failed, succeeded = {}, set()
        for chunk in rows:  # a busy key's rows come in chunks; what is kept of them is bounded by the seconds
            at = chunk["at_s"].to_numpy(np.int64)
            for second, n in zip(*np.unique(at[chunk["failed"].to_numpy(bool)], return_counts=True), strict=True):
                failed[int(second)] = failed.get(int(second), 0) + int(n)
            succeeded |= set(np.unique(at[chunk["succeeded"].to_numpy(bool)]).tolist())
        for second in sorted(failed.keys() | succeeded):
            known.see(second, failed.get(second, 0), second in succeeded)
        yield from self._store(key, known, timer, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        # A timer that is set while another fires waits for the next batch, so all that is due by now goes at once.
        known.pass_time(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000)
        yield from self._store(key, known, timer, True)


def failure_changes(events: DataFrame, key: str, at: str, failed: Column, succeeded: Column, window_s: int = 900, late: str = "5 minutes") -> DataFrame:
    """The log of changes of a stream; start it within keyed_state(), in append mode. Rows that are neither are left out."""
    # Rows at the watermark are dropped and timers at it fire: a millisecond more on both sides keeps rows as old as `late` allows.
    rows = events.withColumn("__time", F.col(at) + F.expr("INTERVAL '0.001' SECOND")).withWatermark("__time", f"{late} 1 milliseconds").filter(failed | succeeded)
    rows = rows.select(key, "__time", F.unix_timestamp(F.date_trunc("second", at)).alias("at_s"), failed.alias("failed"), succeeded.alias("succeeded")).filter(F.col(key).isNotNull())
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(FailureProcessor(key, window_s), f"{key} {kind}, at bigint, seq bigint, n bigint, oldest bigint", "append", "eventtime")


def as_of(changes: DataFrame, key: str, points: DataFrame) -> DataFrame:
    """point, key, n and oldest of the keys with failures at each point in time (column point, in seconds; a few rows)."""
    known = changes.join(F.broadcast(points), F.col("at") <= F.col("point"))
    last = known.groupBy("point", key).agg(F.max_by(F.struct("n", "oldest"), F.struct("at", "seq")).alias("s"))
    return last.select("point", key, "s.n", "s.oldest").filter("n > 0")
