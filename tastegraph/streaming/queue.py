"""The refresh queue as a stream with timers.

Events ``(username, kind, ts)`` with kind ``request``, ``taken``, ``ok`` or ``fail``; ``ts`` is an event time
with a watermark, and timers fire as the watermark passes. A name that failed is handed out again
after ``RETRY_AFTER`` seconds; one that failed ``ATTEMPTS`` times is dropped, and so is one that was handed
out and not heard of for ``EXPIRE`` seconds ``ATTEMPTS`` times. Rows out are ``(username, event, attempts, at)``
with event ``ready`` (to be worked on, oldest ``insert_time`` first), ``done``, ``failed`` or ``dropped``.

Each name has its own state, so one that is asked for very often is one small row; events of a
name within a batch are taken by time, then by kind. An event for a name that is not in the
queue, but a request, changes nothing; neither does a request for one that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tastegraph.streaming.refresh import ATTEMPTS, FAILED, NEW, RETRY_AFTER, TAKEN

EXPIRE = 86400
OUT = "username string, event string, attempts int, at long, insert_time long"
#: Kinds in the order in which events of one time are taken.
KINDS = ("request", "taken", "ok", "fail")


class QueueProcessor(StatefulProcessor):
    """One name of the queue: ``status, attempts, insert_time, changed`` and the time of its timer."""

    def __init__(self, retry_after: int = RETRY_AFTER, attempts: int = ATTEMPTS, expire: int = EXPIRE):
        self.retry_after, self.most, self.expire = retry_after, attempts, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("name", "status int, attempts int, insert_time long, changed long, timer long")

    def _timer(self, old: int, new: int) -> int:
        """One timer at most stands for a name; 0 is none."""
        if old != new:
            if old:
                self.handle.deleteTimer(old * 1000)
            if new:
                self.handle.registerTimer(new * 1000)
        return new

    def _dropped(self, timer: int) -> None:
        self._timer(timer, 0)
        self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, inserted, changed, timer = self.state.get() if self.state.exists() else (-1, 0, 0, 0, 0)
        events = pd.concat(list(rows))
        events = events.assign(order=events["kind"].map({k: n for n, k in enumerate(KINDS)})).sort_values(["ts", "order"])
        out = []
        for kind, at in zip(events["kind"], events["ts"].astype("int64") // 10**9 if events["ts"].dtype == "datetime64[ns]" else events["ts"].map(lambda t: int(t.timestamp()))):
            if kind == "request":
                if status < 0:
                    status, attempts, inserted, changed = NEW, 0, at, at
                    out.append(("ready", attempts, at, inserted))
                continue
            if status < 0:
                continue
            changed = at
            if kind == "taken":
                status = TAKEN
            elif kind == "ok":
                out.append(("done", attempts + 1, at, inserted))
                status = -1
            elif kind == "fail":
                status, attempts = FAILED, attempts + 1
                out.append(("failed" if attempts < self.most else "dropped", attempts, at, inserted))
                if attempts >= self.most:
                    status = -1
            if status < 0:
                attempts = 0
        if status < 0:
            if self.state.exists():
                self._dropped(timer)
        else:
            due = changed + self.retry_after if status == FAILED else changed + self.expire if status == TAKEN else 0
            self.state.update((status, attempts, inserted, changed, self._timer(timer, int(due))))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["username", "event", "attempts", "at", "insert_time"]).astype({"attempts": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, attempts, inserted, changed, timer = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if at != timer:
            return
        lost = status == TAKEN
        attempts += lost
        if attempts >= self.most:
            self.state.clear()
            event = "dropped"
        else:
            self.state.update((NEW, attempts, inserted, at, 0))
            event = "ready"
        yield pd.DataFrame([(key[0], event, attempts, at, inserted)], columns=["username", "event", "attempts", "at", "insert_time"]).astype({"attempts": "int32"})

    def close(self) -> None:
        pass


def timed_queue(events: DataFrame, delay: str = "0 seconds", retry_after: int = RETRY_AFTER, attempts: int = ATTEMPTS, expire: int = EXPIRE) -> DataFrame:
    """The stream of what happens to each name; needs the RocksDB state store (``use_rocksdb``)."""
    named = events.where(F.col("username").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*KINDS)).select("username", "kind", F.col("ts").cast("timestamp").alias("ts"))
    return named.withWatermark("ts", delay).groupBy("username").transformWithStateInPandas(QueueProcessor(retry_after, attempts, expire), OUT, "Update", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
