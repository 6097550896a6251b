"""The queue as a stream: retries, drops and expiry over several batches."""

from datetime import datetime, timezone

import pytest

from tastegraph.streaming import queue

T0 = 1_000_000


@pytest.fixture
def feed(spark, tmp_path):
    """A function that streams rows through the queue, one file a batch, and gives what came out."""
    queue.use_rocksdb(spark)
    schema, number, seen = "username string, kind string, ts timestamp", [0], []

    def add(frame, epoch):
        seen.extend(tuple(r)[:4] for r in frame.collect())

    def step(rows):
        folder = tmp_path / "in"
        part = spark.createDataFrame([(u, k, datetime.fromtimestamp(T0 + t, timezone.utc)) for u, k, t in rows], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
        number[0] += 1
        seen.clear()
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = queue.timed_queue(stream).writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((u, e, a, t - T0) for u, e, a, t in seen)

    return step


def test_a_name_fails_returns_and_is_dropped(feed):
    assert feed([("bad", "request", 0), ("bad", "request", 1), ("good", "request", 2), (None, "request", 3), ("none", "ok", 3)]) == [("bad", "ready", 0, 0), ("good", "ready", 0, 2)]
    assert feed([("bad", "taken", 5), ("bad", "fail", 10), ("good", "taken", 6), ("good", "ok", 11)]) == [("bad", "failed", 1, 10), ("good", "done", 1, 11)]
    assert feed([("clock", "request", 100)]) == [("clock", "ready", 0, 100)]  # 90 s later: not yet
    out = feed([("clock", "ok", 200)])
    assert ("bad", "ready", 1, 130) in out and ("clock", "done", 1, 200) in out
    assert feed([("bad", "taken", 201), ("bad", "fail", 210)]) == [("bad", "failed", 2, 210)]
    assert feed([("tick", "request", 400)]) == [("bad", "ready", 2, 330), ("tick", "ready", 0, 400)]
    assert feed([("bad", "fail", 410)]) == [("bad", "dropped", 3, 410)]
    assert feed([("tick", "ok", 1000)]) == [("tick", "done", 1, 1000)]  # no timer of the dropped name fires
    assert feed([("bad", "request", 1001)]) == [("bad", "ready", 0, 1001)]  # and it may be asked for anew


def test_a_name_never_heard_of_again_expires(feed):
    day = queue.EXPIRE
    feed([("lost", "request", 0), ("lost", "taken", 1)])
    for k in range(1, queue.ATTEMPTS + 1):
        out = feed([("clock", "request", k * 2 * day)])
        want = "dropped" if k == queue.ATTEMPTS else "ready"
        assert [r[:3] for r in out if r[0] == "lost"] == [("lost", want, k)], (k, out)
        if k < queue.ATTEMPTS:
            feed([("lost", "taken", k * 2 * day + 1)])
    assert not [r for r in feed([("clock", "request", 9 * day)]) if r[0] == "lost"]
