"""Nearest users by bands and prefixes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import models, similarity


def near(a, b):
    low, high = min(a, b), max(a, b)
    return low > 0 and ((low < 5 and high < 10) or high < 2 * low)


@pytest.fixture(scope="module")
def tastes(spark):
    """Users of ten tastes; a few items are on nearly every list, with small weights."""
    rng = np.random.default_rng(5)
    rows = []
    for u in range(240):
        group = u % 10
        for i in rng.permutation(60)[: 12 + u % 20]:
            rows.append((u, int(1000 + 60 * group + i), 2, int(rng.integers(8, 11))))
        rows += [(u, int(i), 2, 7) for i in range(8) if rng.random() < 0.9]
        rows += [(u, int(5000 + rng.integers(0, 400)), 4, 1) for _ in range(3)]
    return spark.createDataFrame(rows, "user_id long, item_id long, status int, rating int").dropDuplicates(["user_id", "item_id"])


def all_pairs(scored, stats, k):
    """By numpy over every two users."""
    completed = {r["user_id"]: r["completed"] for r in stats.collect()}
    lists = {}
    for r in scored.collect():
        lists.setdefault(r["user_id"], {})[r["item_id"]] = int(r["q"])
    norm = {u: sum(q * q for q in x.values()) for u, x in lists.items()}
    out = {}
    for u, x in lists.items():
        found = []
        for o, y in lists.items():
            if o != u and norm[u] and norm[o] and near(completed[u], completed[o]) and x.keys() & y.keys():
                found.append((-round(sum(q * y[i] for i, q in x.items() if i in y) / (float(norm[u]) * norm[o]) ** 0.5, 9), o))
        out[u] = sorted(found)[:k]
    return {(u, rk, o): -s for u, found in out.items() for rk, (s, o) in enumerate(found, 1)}


@pytest.mark.parametrize("chunk", [similarity.CHUNK, 7])
def test_pruned_is_all_pairs_with_fewer_pairs(spark, tastes, chunk):
    scored, stats = S.scored(tastes), S.user_stats(tastes)
    found, stages = similarity.pruned_user_cosine(scored, stats, k=5, chunk=chunk)
    got = {(r["user_id"], r["rk"], r["other_id"]): r["score"] for r in found.collect()}
    want = all_pairs(scored, stats, 5)
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 2e-9
    every = similarity.item_pairs(similarity._lists(scored, stats), similarity._lists(scored, stats)).count()
    made = {name: df.count() for name, df in stages.items()}
    assert made["probed"] + made["prefix"] + made["without floor"] < 0.6 * every, (made, every)
    assert made["survivors"] < 0.5 * every


def test_direct_search_is_all_pairs(spark, tastes):
    scored, stats = S.scored(tastes), S.user_stats(tastes)
    want = all_pairs(scored, stats, 5)
    got = {(r["user_id"], r["rk"], r["other_id"]): r["score"] for r in models.user_cosine(scored, stats, k=5).collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 2e-9
    some = spark.createDataFrame([(3,), (17,)], "user_id long")
    assert {(r["user_id"], r["rk"], r["other_id"]) for r in models.user_cosine(scored, stats, some, 5).collect()} == {x for x in want if x[0] in (3, 17)}


def test_users_of_like_activity_are_at_most_a_band_apart(spark):
    counts = spark.createDataFrame([(c,) for c in range(600)], "completed long")
    found = {(r["completed"], r["completed_b"]) for r in similarity.alike(counts, counts.withColumnRenamed("completed", "completed_b")).collect()}
    assert found == {(a, b) for a in range(600) for b in range(600) if near(a, b)}


def test_long_lists_are_cut_and_pairs_kept(spark):
    rows = spark.range(300).select(F.col("id").alias("user_id"), F.lit(1).alias("item_id"), F.lit(2).alias("q"), F.lit(10).alias("completed"))
    pairs = similarity.item_pairs(rows, rows, chunk=25)
    assert pairs.count() == 300 * 299 == pairs.select("user_id", "other_id").distinct().count()
    assert similarity.item_pairs(rows, rows, chunk=25, once=True).count() == 150 * 299


def test_plans_have_no_nested_loop(spark, tastes):
    scored, stats = S.scored(tastes), S.user_stats(tastes)
    for df in (models.user_cosine(scored, stats), similarity.alike(stats.select("completed"), stats.select(F.col("completed").alias("completed_b")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_users(spark, tastes):
    none = tastes.limit(0)
    assert similarity.pruned_user_cosine(S.scored(none), S.user_stats(none))[0].collect() == []
