"""Refresh queue and change sync, as batch functions and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.plans.numbering import numbered

NEW, TAKEN, FAILED, DONE = 0, 1, 2, 3
RETRY_AFTER, ATTEMPTS = 120, 3


def enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """``queue`` with a new row for each requested name that it lacks; the earliest request counts."""
    first = requests.groupBy("username").agg(F.min("ts").alias("insert_time")).join(queue, "username", "left_anti")
    fresh = first.select("username", "insert_time", F.lit(NEW).alias("status"), F.lit(0).alias("attempts"), F.col("insert_time").alias("status_change"))
    return queue.unionByName(fresh)


def positions(queue: DataFrame) -> DataFrame:
    """One more than the number of waiting names that came earlier."""
    waiting = queue.where(F.col("status") == NEW).select("username", "insert_time")
    return numbered(waiting, [F.floor(F.col("insert_time") / 600)], [F.col("insert_time")], "position", ties=True).select("username", "position")


def due(queue: DataFrame, now: Column | int, n: int = 1) -> DataFrame:
    """The ``n`` oldest names to work on: new ones, and failures that may be tried again."""
    now = F.lit(now) if isinstance(now, int) else now
    ready = (F.col("status") == NEW) | ((F.col("status") == FAILED) & (F.col("status_change") < now - RETRY_AFTER) & (F.col("attempts") < ATTEMPTS))
    return queue.where(ready).orderBy("insert_time", "username").limit(n)


def settle(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``queue`` after outcomes ``(username, ok, ts)``; any failure of a name fails it."""
    one = outcomes.groupBy("username").agg(F.min(F.col("ok").cast("int")).alias("ok"), F.max("ts").alias("ts"))
    rows = queue.join(one, "username", "left")
    changed = F.col("ok").isNotNull()
    status = F.when(changed, F.when(F.col("ok") == 1, DONE).otherwise(FAILED)).otherwise(F.col("status"))
    return rows.select("username", "insert_time", status.cast("int").alias("status"), (F.col("attempts") + changed.cast("int")).alias("attempts"), F.coalesce("ts", "status_change").alias("status_change"))


def purge(queue: DataFrame) -> DataFrame:
    """``queue`` without finished names and those that failed too often."""
    return queue.where(~((F.col("status") == DONE) | ((F.col("status") == FAILED) & (F.col("attempts") >= ATTEMPTS))))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ties by all of ``order``."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with the last change of each key in place of its row."""
    last = latest(changes, keys, order)
    return target.join(last, keys, "left_anti").unionByName(last.select(*target.columns))


def changed_since(rows: DataFrame, thresholds: DataFrame, key: str, column: str = "last_change") -> DataFrame:
    """Rows that changed after what the other side has; keys that it lacks count as never seen."""
    return rows.join(thresholds.select(key, "threshold"), key, "left").where(F.col(column) > F.coalesce("threshold", F.lit(-1))).drop("threshold")


def pulled(local: DataFrame, remote: DataFrame, key: str, time: str) -> DataFrame:
    """``local`` after a pull: rows that the remote side has newer, or alone, take their place; the rest stays."""
    news = changed_since(remote, local.select(key, F.col(time).alias("threshold")), key, time)
    return local.join(news, key, "left_anti").unionByName(news.select(*local.columns))


def one_owner(users: DataFrame) -> DataFrame:
    """Blank all but the newest holder of each name."""
    w = W.partitionBy("username").orderBy(F.desc("last_update"), F.desc("user_id"))
    return users.withColumn("username", F.when(F.row_number().over(w) == 1, F.col("username")).otherwise(""))


def queue_stream(events: DataFrame) -> DataFrame:
    """The queue as a keyed stream: events ``(username, kind, ts)`` with kind request, ok or fail.

    Emits each name's status after every micro-batch in which it changed; a name that is done or
    failed too often leaves the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, attempts, inserted = state.get if state.exists else (-1, 0, 0)
        for row in pd.concat(list(batches)).sort_values(["ts", "kind"]).itertuples():
            if row.kind == "request":
                if status < 0:
                    status, attempts, inserted = NEW, 0, int(row.ts)
            elif status in (NEW, TAKEN, FAILED):
                status, attempts = (DONE if row.kind == "ok" else FAILED), attempts + 1
        if status == DONE or attempts >= ATTEMPTS:
            if state.exists:
                state.remove()
        elif status >= 0:
            state.update((status, attempts, inserted))
        if status >= 0:
            yield pd.DataFrame({"username": [key[0]], "status": [status], "attempts": [attempts], "insert_time": [inserted]})

    return events.groupBy("username").applyInPandasWithState(step, "username string, status int, attempts int, insert_time long", "status int, attempts int, insert_time long", "update", "NoTimeout")
