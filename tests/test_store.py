"""Stored tables: upserts that rewrite touched buckets alone, side tables, died runs, two-way sync."""

import os

import pytest
from pyspark.sql import functions as F

from tastegraph.streaming.store import BucketedTable, Marks, sync, upsert, upsert_stream

ITEM = "item_id long, title string, at long"
GENRE = "item_id long, genre int, place int"


def files(table):
    top = table.path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def content(table):
    return sorted(tuple(r) for r in table.rows().collect())


@pytest.fixture
def items(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/items", "item_id", ITEM, 16)
    return table.create(spark.createDataFrame([(i, f"t{i}", 1) for i in range(200)], ITEM))


def test_a_batch_rewrites_touched_buckets_alone(spark, items):
    before = files(items)
    rows = spark.createDataFrame([(5, "old", 2), (5, "new", 3), (7, "t7", 1), (999, "more", 2), (None, "none", 9)], ITEM)
    touched = upsert(items, rows, ["at"], "0")[""]
    assert set(touched) == set(items.touched(spark.createDataFrame([(5,), (999,)], "item_id long")))
    now = files(items)
    for path, stamp in before.items():
        assert (now.get(path) == stamp) == (int(path.split("_bucket=")[1].split("/")[0]) not in touched)
    want = {i: (i, f"t{i}", 1) for i in range(200)} | {5: (5, "new", 3), 999: (999, "more", 2)}
    assert content(items) == sorted(want.values())
    assert upsert(items, rows, ["at"], "0") == {"": []} and files(items) == now  # a replay
    assert upsert(items, spark.createDataFrame([(5, "late", 2), (6, "newer", 5)], ITEM), ["at"], "1", newer="at")[""]
    assert dict((r[0], r[1]) for r in content(items))[5] == "new" and dict((r[0], r[1]) for r in content(items))[6] == "newer"


def test_side_rows_go_with_their_item(spark, items, tmp_path):
    genres = BucketedTable(spark, f"file://{tmp_path}/genres", "item_id", GENRE, 4)
    genres.create(spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 10, 0), (3, 12, 0)], GENRE))
    schema = f"{ITEM}, genres array<struct<genre int, place int>>"
    rows = spark.createDataFrame([(1, "t1", 1, [(11, 0)]), (2, "t2", 1, []), (3, "x", 2, None), (300, "n", 1, [(7, 0), (7, 0)])], schema)
    upsert(items, rows, ["at"], "0", {"genres": genres})
    assert content(genres) == [(1, 11, 0), (3, 12, 0), (300, 7, 0), (300, 7, 0)]
    still = files(genres)
    assert upsert(items, rows, ["at"], "1", {"genres": genres}) == {"": [], "genres": []} and files(genres) == still
    upsert(items, spark.createDataFrame([(i, "t", 9, []) for i in (1, 3, 300)], schema), ["at"], "2", {"genres": genres})
    assert content(genres) == [] and genres.rows().columns == ["item_id", "genre", "place"]


def test_a_died_run_is_made_good(spark, items, monkeypatch):
    def die(self, staged):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            upsert(items, spark.createDataFrame([(5, "new", 3)], ITEM), ["at"], "7")
    assert (5, "t5", 1) in content(items)
    # The worst case: the old bucket is gone already, and only the staged rows are left.
    b = items.touched(spark.createDataFrame([(5,)], "item_id long"))[0]
    items._delete(f"{items.path}/_bucket={b}")
    assert items.recover() == ["_staged-7"] and (5, "new", 3) in content(items) and len(content(items)) == 200
    assert items.recover() == []


def test_stream_of_changes(spark, items, tmp_path):
    folder, at = str(tmp_path / "changes"), str(tmp_path / "at")
    for n in (1, 2):
        spark.createDataFrame([(i, f"v{n}", 10 * n) for i in range(0, 200, 50 * n)], ITEM).coalesce(1).write.mode("append").parquet(folder)
        query = upsert_stream(spark.readStream.schema(ITEM).parquet(folder), items, ["at"], at, newer="at")
        query.awaitTermination(120)
        assert query.exception() is None
    found = {r[0]: r[1] for r in content(items)}
    assert (found[0], found[100], found[50], found[150], found[1]) == ("v2", "v2", "v1", "v1", "t1")


def test_two_stores_are_equal_after_a_run_each_way(spark, items, tmp_path):
    other = BucketedTable(spark, f"file://{tmp_path}/other", "item_id", ITEM, 8)
    mine = {i: (i, f"t{i}", 1) for i in range(200)}
    theirs = {i: (i, f"t{i}" if i % 3 == 1 else f"o{i}", i % 3) for i in range(100, 260)}
    other.create(spark.createDataFrame(list(theirs.values()), ITEM))
    there, back = Marks(spark, f"file://{tmp_path}/there"), Marks(spark, f"file://{tmp_path}/back")
    assert sync(items, other, "at", there, page=50) == {"pages": 5, "sent": 100 + sum(1 for i in range(100, 200) if theirs[i][2] < 1)}
    assert sync(other, items, "at", back, page=70)["sent"] == 60 + sum(1 for i in range(100, 200) if theirs[i][2] > 1)
    want = {i: max((x[i] for x in (mine, theirs) if i in x), key=lambda r: r[2]) for i in range(260)}
    assert content(items) == content(other) == sorted(want.values())
    # Later passes look at what has changed since.
    assert there.get() == (None, 1) and back.get() == (None, 2)
    upsert(items, spark.createDataFrame([(3, "fresh", 50), (400, "only", 60)], ITEM), ["at"], "x")
    assert sync(items, other, "at", there, page=1000)["sent"] == 2
    assert content(items) == content(other)


def test_a_died_pass_goes_on_behind_its_last_page(spark, items, tmp_path):
    other, marks = BucketedTable(spark, f"file://{tmp_path}/other", "item_id", ITEM, 8), Marks(spark, f"file://{tmp_path}/m")
    other.create(spark.createDataFrame([(i, "o", 0) for i in range(0, 200, 2)], ITEM))

    def die(end):
        if end > 80:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sync(items, other, "at", marks, page=20, on_page=die)
    at = marks.get()[0]
    assert at > 80 and {r[0] for r in content(other)} >= set(range(at + 1)) and 199 not in {r[0] for r in content(other)}
    sync(items, other, "at", marks, page=20)
    assert content(items) == content(other) and marks.get()[0] is None
