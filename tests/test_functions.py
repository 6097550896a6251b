"""Small golden cases of functions, search, lists, factors and the queue."""

import numpy as np
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import factors, search
from tastegraph.plans.components import connected_components
from tastegraph.sources import lists
from tastegraph.streaming import refresh


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_http_dates(spark):
    for text in ("Sun, 06 Nov 1994 08:49:37 GMT", "Sunday, 06-Nov-94 08:49:37 GMT", "Sun Nov  6 08:49:37 1994"):
        assert one(spark, S.http_date(F.col("t")), t=text) == 784111777
    assert one(spark, S.http_date(F.col("t")), t="nonsense") == 0


def test_relative_dates(spark):
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    at = lambda t: one(spark, S.relative_date(F.col("t"), now), t=t)
    assert at("10 seconds ago") == 1_699_999_990
    assert at("5 minutes ago") == (1_700_000_000 - 300) // 60 * 60
    assert at("2 hours ago") == (1_700_000_000 - 7200) // 3600 * 3600
    assert at("Today, 1:05 PM") == 1_699_920_000 + 13 * 3600 + 300
    assert at("Yesterday, 1:05 PM") == 1_699_920_000 - 86400 + 13 * 3600 + 300
    assert at("whenever") is None


def test_small_functions(spark):
    assert one(spark, S.quantized(F.lit(-1.99)), t="") == -63
    assert one(spark, S.letter(F.col("t")), t="¡ñ 9z") == "0"
    assert one(spark, S.letter(F.col("t")), t="  zulu") == "Z"
    assert one(spark, S.short_date(F.col("t")), t="04-01-07") == "2007-04-01"
    assert one(spark, S.adjusted_date(F.col("t")), t="2007-04-00") == "2007-04-01"
    assert one(spark, S.tokens(F.col("t")), t="--Ab c9!") == ["ab", "c9"]


def test_edit_budgets():
    assert search.edit_match("ab", "abc") == (0, 1)
    assert search.edit_match("ax", "abc") is None
    assert search.edit_match("axc", "abcd") == (1, 1)
    assert search.edit_match("abx", "abc") is None  # no edit on the last character
    assert search.edit_match("stxxngest", "strongest") == (2, 0)


def test_suggest_orders_by_match_and_rank(spark):
    titles = spark.createDataFrame([(1, 0, "red river"), (2, 0, "river red"), (3, 0, "driver")], "item_id long, title_id int, title string")
    ranks = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "item_id long, rank int")
    q = spark.createDataFrame([("river",), ("red riv",)], "query string")
    got = {(r["query"], r["rk"]): r["item_id"] for r in search.substring_suggest(titles, ranks, q).collect()}
    assert [got["river", k] for k in (1, 2, 3)] == [2, 1, 3]
    got = {(r["query"], r["rk"]): r["item_id"] for r in search.fuzzy_suggest(titles, ranks, q).collect()}
    assert got["red riv", 1] == 2 and got["red riv", 2] == 1  # the order of words does not count, the rank does


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fold_in_solves_normal_equations(spark):
    rng = np.random.default_rng(1)
    f, v = rng.normal(size=(6, 3)), rng.normal(size=6)
    rows = spark.createDataFrame([(7, i, float(v[i])) for i in range(6)], "item_id long, user_id long, v double")
    users = spark.createDataFrame([(i, f[i].tolist()) for i in range(6)], "id long, features array<double>")
    got = np.array(factors.fold_in(rows, users, "item_id", "user_id", "v", 0.1).first()["features"])
    assert np.allclose(got, np.linalg.solve(f.T @ f + 0.6 * np.eye(3), f.T @ v))


def test_lists(spark):
    df = spark.createDataFrame([(1, "[[5,2,9,12],[3,1,0]]"), (2, "broken"), (3, None)], "user_id long, list string")
    assert [tuple(r) for r in lists.read_lists(df).collect()] == [(1, 3, 1, 0, 0), (1, 5, 2, 9, 12)]
    assert one(spark, S.adjusted_date(S.short_date(F.col("t"))), t="04-00-98") == "1998-04-01"


def test_queue_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "request", 1), ("a", "fail", 2), ("b", "request", 1), ("b", "ok", 3)]
    spark.createDataFrame(rows, "username string, kind string, ts long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("username string, kind string, ts long").parquet(src)
    q = refresh.queue_stream(stream).writeStream.outputMode("update").format("memory").queryName("queue_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["username"]: (r["status"], r["attempts"]) for r in spark.table("queue_out").collect()} == {"a": (2, 1), "b": (3, 1)}


def test_upsert_and_sync(spark):
    target = spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "id long, t long, v string")
    changes = spark.createDataFrame([(2, 11, "c"), (2, 12, "d"), (3, 5, "e")], "id long, t long, v string")
    assert {(r["id"], r["v"]) for r in refresh.upsert(target, changes, ["id"], ["t", "v"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
