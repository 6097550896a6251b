"""Factor models, samples and stored models on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import attach, evaluate, factors, models, recommend
from tastegraph.plans import numbering, scratch
from tastegraph.sources import models as stored
from tastegraph.streaming import changes, refresh


@pytest.fixture(scope="module")
def rated(spark):
    """Users of two tastes over forty items, with ids beyond 32 bits."""
    rng = np.random.default_rng(0)
    rows = []
    for u in range(80):
        for i in rng.permutation(40)[:32]:
            like = (u % 2) == (i % 2)
            rows.append((2**40 + u, 2**41 + int(i), 2, int(np.clip(round(8 * like + 2 + rng.normal(0, 1)), 1, 10))))
    return spark.createDataFrame(rows, "user_id long, item_id long, status int, rating int")


def test_als_error_falls_and_hidden_ratings_are_predicted(spark, rated):
    scored = S.scored(rated)
    error = [factors.rmse(scored, *factors.fit_als(scored, 4, 0.05, n), every=1).first()["rmse"] for n in (1, 4, 12)]
    assert error[2] <= error[1] <= error[0] and error[2] < 0.6
    held = scratch.materialize(evaluate.hidden(scored), "held")
    assert {r["count"] for r in held.groupBy("user_id").count().collect()} == {8}
    row = factors.hidden_rmse(rated, held, 4, 0.05, 8).first()
    assert row["n"] == 640 and row["rmse"] < 0.7
    grid = factors.grid_search(rated, [2, 4], [0.1], 4, 2).collect()
    assert {(r["rank"], r["rounds"]) for r in grid} == {(2, 2), (2, 4), (4, 2), (4, 4)} and all(r["rmse"] < 1 for r in grid)


def test_als_users_are_near_a_solution_of_their_normal_equations(spark, rated):
    scored = S.scored(rated)
    users, items = factors.fit_als(scored, 4, 0.1, 20)
    own = {r["id"]: np.array(r["features"]) for r in users.collect()}
    again = {r["user_id"]: np.array(r["features"]) for r in factors.fold_in_users(scored, items, 0.1).collect()}
    assert own.keys() == again.keys() and max(np.abs(own[u] - again[u]).max() for u in own) < 0.02


def test_fold_in_in_parts_is_the_whole(spark, rated, monkeypatch):
    scored = S.scored(rated)
    _, items = factors.fit_als(scored, 3, 0.1, 3)
    items = scratch.materialize(items, "items")
    solve = lambda: {r["user_id"]: r["features"] for r in factors.fold_in_users(scored, items).collect()}
    whole, by_key = solve(), factors._by_key
    monkeypatch.setattr(factors, "_by_key", lambda *a: by_key(*a, chunk=5))
    parts = solve()
    assert whole.keys() == parts.keys() and all(np.allclose(whole[u], parts[u]) for u in whole)


def test_projection_is_near_the_cosine(spark, rated):
    scored = S.scored(rated)
    vectors = {r["id"]: np.array(r["features"]) for r in factors.sign_projection(scored, 4000).collect()}
    exact = {(r["item_id"], r["similar_id"]): r["score"] for r in models.item_cosine(scored, 60).collect()}
    assert len(vectors) == 40 and max(abs(vectors[a] @ vectors[b] - s) for (a, b), s in exact.items()) < 0.12
    one, two = (factors.item_neighbours(factors.sign_projection(scored, 2000, s), spark.createDataFrame([], "item_id long, group_id long"), 10) for s in (1, 2))
    share = evaluate.neighbour_stability(one, two).first()
    assert share["total"] == 400 and share["share"] > 0.5
    assert evaluate.neighbour_stability(one, one).first()["share"] == 1


def test_neighbours_in_blocks_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5))
    stats = spark.createDataFrame([(i, int(rng.integers(0, 40))) for i in range(90)], "user_id long, completed long")
    count = {r["user_id"]: r["completed"] for r in stats.collect()}
    f = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "id long, features array<double>")
    for metric in ("dot", "cosine"):
        got = {(r["user_id"], r["rk"]): r["other_id"] for r in factors.user_neighbours(f, stats, metric=metric, k=5).collect()}
        y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
        for u in range(90):
            near = lambda a, b: min(a, b) > 0 and ((min(a, b) < 5 and max(a, b) < 10) or max(a, b) < 2 * min(a, b))
            fit = sorted((-round(float(y[u] @ y[v]), 9), v) for v in range(90) if v != u and near(count[u], count[v]))[:5]
            assert [got.get((u, k + 1)) for k in range(len(fit))] == [v for _, v in fit] and (u, len(fit) + 1) not in got


def test_blocks_that_cannot_help_are_skipped(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6)) * np.exp(rng.normal(size=(900, 1)) * 1.5)
    x[5] = 0
    ids = list(range(900))
    left = spark.createDataFrame([(i, x[i].tolist(), [i]) for i in ids], "a long, features array<double>, skip array<long>")
    right = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "b long, features array<double>")
    for metric in ("dot", "cosine"):
        report: list = []
        got = {(r["a"], r["rk"]): (r["b"], r["score"]) for r in factors.block_top(left, right, 7, 64, metric, report=report).collect()}
        y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
        score = np.round(y @ y.T, 9)
        for i in ids:
            order = [o for o in np.lexsort((ids, -score[i])) if o != i][:7]
            assert [got[i, r + 1][0] for r in range(7)] == order, (metric, i)
        seen = report[0].first()
        assert seen["pairs"] == 900 * 15 and (metric == "cosine" or seen["met"] < 0.4 * seen["pairs"]), seen


def test_rounds_go_on_from_stored_factors(spark, rated):
    scored = S.scored(rated)
    runs = list(factors.als_rounds(scored, 4, 0.1, 6, every=2))
    assert [r[0] for r in runs] == [2, 4, 6] and set(runs[-1][3]) == {"users", "items"} and min(runs[-1][3].values()) > 0
    error = [factors.rmse(scored, u, i, every=1).first()["rmse"] for _, u, i, _ in runs]
    assert error[2] <= error[1] <= error[0] < 1
    two = {r["id"]: r["features"] for r in runs[1][2].collect()}
    (_, _, items, _), = factors.als_rounds(scored, 4, 0.1, 2, start=runs[0][2])
    again = {r["id"]: r["features"] for r in items.collect()}
    assert again.keys() == two.keys() and all(np.allclose(again[i], two[i], atol=1e-9) for i in two)
    # The items' factors solve their normal equations on the users' of the same round.
    users = {r["id"]: np.array(r["features"]) for r in runs[-1][1].collect()}
    own: dict = {}
    for r in scored.collect():
        own.setdefault(r["item_id"], []).append((users[r["user_id"]], r["norm"]))
    for r in runs[-1][2].collect():
        f, v = (np.array(c) for c in zip(*own[r["id"]]))
        assert np.allclose((f.T @ f + 0.1 * len(v) * np.eye(4)) @ r["features"], f.T @ v, atol=1e-8)


def test_methods(spark, rated):
    scored, stats = S.scored(rated), S.user_stats(rated)
    items = rated.select("item_id").distinct().withColumn("restricted", F.col("item_id") % 10 == 0).withColumn("group_id", F.col("item_id"))
    users, factor = factors.fit_als(scored, 4, 0.1, 6)
    give = {"model": models.co_occurrence(scored, items), "user_factors": users, "item_factors": factor}
    target = stats.select("user_id").orderBy("user_id").limit(6)
    seen = {(r["user_id"], r["item_id"]) for r in rated.collect()}
    for method in recommend.METHODS:
        rows = recommend.recommend(method, rated, scored, stats, items, targets=target, **give).collect()
        assert rows and len({r["user_id"] for r in rows}) == 6
        assert all((r["user_id"], r["item_id"]) not in seen and r["item_id"] % 10 for r in rows)
        if method in ("factors", "cosine", "factor-users"):  # the first of the list is of the user's own taste
            first = [r for r in rows if r["rk"] == 1]
            assert sum(r["user_id"] % 2 == r["item_id"] % 2 for r in first) >= 5
    with pytest.raises(ValueError):
        recommend.recommend("chance", rated, scored, stats, items)


def test_drawn_methods(spark, rated):
    scored, stats = S.scored(rated), S.user_stats(rated)
    items = rated.select("item_id").distinct().withColumn("restricted", F.lit(False)).withColumn("group_id", F.col("item_id"))
    given = {"model": models.co_occurrence(scored, items)}
    names = ("pearson", "co-occurrence")
    chosen = {r["user_id"]: r["method"] for r in recommend.drawn_methods(stats, names).collect()}
    got = [(r["user_id"], r["method"], r["rk"], r["item_id"]) for r in recommend.recommend_drawn(rated, scored, stats, items, names, **given).collect()]
    want = [(r["user_id"], m, r["rk"], r["item_id"]) for m in names for r in recommend.recommend(m, rated, scored, stats, items, **given).collect() if chosen[r["user_id"]] == m]
    assert sorted(got) == sorted(want) and {m for _, m, _, _ in got} == set(names)
    many = recommend.drawn_methods(spark.range(4000).withColumnRenamed("id", "user_id")).groupBy("method").count().collect()
    assert {r["method"] for r in many} == set(recommend.DRAWN) and all(850 < r["count"] < 1150 for r in many)


def test_lists_in_progress(spark, rated):
    """Every method's list in progress: no known, restricted, finished or old item, by votes of the models given."""
    as_of, day = 1_000_000_000, 86400
    scored, stats = S.scored(rated), S.user_stats(rated)
    watched = [(u, 900 + u % 6, 1, 0) for u in (r["user_id"] for r in stats.collect())]
    ratings = rated.select("user_id", "item_id", "status", "rating").union(spark.createDataFrame(watched, "user_id long, item_id long, status int, rating int"))
    fresh = spark.createDataFrame([(900, 1, as_of - day, None, False), (901, 1, as_of - day, None, True), (902, 2, as_of - day, None, False), (903, 1, as_of - 400 * day, None, False), (904, 1, as_of - day, as_of + day, False), (905, 1, as_of - 9 * day, as_of - day, False)], "item_id long, status int, start_at long, end_at long, restricted boolean")
    finished = rated.select("item_id").distinct().select("item_id", F.lit(2).alias("status"), F.lit(0).cast("long").alias("start_at"), F.lit(None).cast("long").alias("end_at"), F.lit(False).alias("restricted"))
    items = finished.unionByName(fresh).withColumn("group_id", F.col("item_id"))
    likes = rated.select("item_id").distinct()
    near = likes.crossJoin(fresh.select(F.col("item_id").alias("similar_id"))).withColumn("score", F.lit(0.5)).withColumn("rk", F.lit(1))
    users, factor = factors.fit_als(scored, 4, 0.1, 4)
    now = fresh.select(F.col("item_id").alias("id"), F.array(*[F.lit(0.5)] * 4).alias("features"))
    give = {"model": near, "user_factors": users, "item_factors": factor, "now_factors": now}
    held = {(r["user_id"], r["item_id"]) for r in ratings.collect()}
    for method in recommend.METHODS:
        rows = recommend.recommend_in_progress(method, ratings, scored, stats, items, as_of, **give).collect()
        assert bool(rows) == (method != "projection-items"), method
        assert all(r["item_id"] in (900, 905) and (r["user_id"], r["item_id"]) not in held and r["rk"] <= 10 for r in rows), method
    with pytest.raises(ValueError):
        recommend.recommend_in_progress("chance", ratings, scored, stats, items, as_of)


def test_drawn_likes(spark, rated):
    scored = S.scored(rated)
    n = {r["n"] for r in models.liked_best(scored, seed=3).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n <= set(range(10, 21)) and len(n) > 3
    assert {r["count"] for r in models.liked_best(scored).groupBy("user_id").count().collect()} == {20}


def test_small_rules(spark):
    row = spark.range(1).select(S.dequantized(F.lit(-48)).alias("q"), *[S.bucket_start(S.activity_bucket(F.lit(c))).alias(f"c{c}") for c in (0, 14, 15, 179, 180, 224, 225)]).first()
    assert tuple(row) == (-1.5, 0, 0, 15, 165, 180, 180, 225)
    row = spark.range(1).select(S.day_of(F.lit(86400 * 5 + 7), F.lit(2)), S.day_of(F.lit(86400 * 5), F.lit(1)), S.latest_change(F.lit(0), F.array(F.lit(3), F.lit(9))), S.latest_change(F.lit(4), F.array(F.lit(9))), S.latest_change(F.lit(None).cast("int"), F.lit(None).cast("array<int>"))).first()
    assert tuple(row) == (5, 0, 9, 4, 0)


def test_numbered_places(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), None if k % 50 == 0 else int(rng.integers(0, 30))) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v int")
    got = {r["id"]: r["place"] for r in numbering.numbered(df, [F.floor(F.col("v") / 4)], [F.col("v"), F.col("id")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    tied = {r["id"]: r["place"] for r in numbering.numbered(df, [F.floor(F.col("v") / 4)], [F.col("v")], ties=True).collect()}
    assert all(tied[i] == 1 + sum((x is not None, x or 0) < (v is not None, v or 0) for _, x in rows) for i, v in rows)


def test_stored_models(spark, tmp_path):
    folder, df = f"file://{tmp_path}", spark.createDataFrame([(1, 2.0)], "id long, score double")
    stored.write_model(df, folder, "a")
    with pytest.raises(FileNotFoundError):
        stored.publish(spark, folder, ["a", "b"])
    with pytest.raises(Exception):
        stored.read_model(spark, folder, "a")
    stored.write_model(df, folder, "b", version=9)
    stored.publish(spark, folder, ["a", "b"])
    assert stored.read_model(spark, folder, "a").collect() == df.collect()
    with pytest.raises(ValueError):
        stored.read_model(spark, folder, "b")
    stored.write_model(df.union(df), folder, "a")
    assert stored.read_model(spark, folder, "a").count() == 1
    stored.publish(spark, folder, ["a"])
    assert stored.read_model(spark, folder, "a").count() == 2
    df.write.parquet(f"{folder}/old/rows")  # without a version: layout 1
    assert stored.read_model(spark, folder, "old", newest=1).count() == 1


def test_samples(spark):
    sample = spark.createDataFrame([(k, 9 - k) for k in range(9)], "user_id long, ord long")
    assert {r["user_id"] for r in evaluate.first_of_sample(sample, 3).collect()} == {6, 7, 8}
    ratings = spark.createDataFrame([(u, i, 2, 5) for u in range(60) for i in range(u % 7, 40, 3)], "user_id long, item_id long, status int, rating int")
    stats = S.user_stats(ratings)
    for dealt in (50_000, 9):
        got = evaluate.stratified_sample(ratings, stats, 40, dealt=dealt).collect()
        assert got and len({r["user_id"] for r in got}) == len(got) and sorted(r["ord"] for r in got) == list(range(1, len(got) + 1))


def test_change_times(spark):
    schema = "user_id long, username string, last_update long, last_change long, last_item_change long, last_other_change long"
    users = spark.createDataFrame([(1, "a", 5, 50, 40, 50), (2, "b", 5, 30, 30, None)], schema)
    seen = spark.createDataFrame([(1, "A", 45), (2, "b", 0), (3, "c", 7)], "user_id long, username string, change long")
    got = {r["user_id"]: tuple(r)[1:] for r in changes.with_change_times(users, seen, 99).collect()}
    assert got == {1: ("A", 99, 50, 45, 50), 2: ("b", 99, 30, 30, None), 3: ("c", 99, 7, 7, None)}
    other = {r["user_id"]: r["last_change"] for r in changes.with_change_times(users, seen, 99, "other").collect()}
    assert other == {1: 45, 2: 30, 3: 7}


def test_pages_by_key(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 8)], "id long")
    after, seen = -1, []
    while after != -1 or not seen:
        page = attach.key_page(df, "id", after, 3)
        seen += [r["id"] for r in page.collect()]
        after = attach.page_end(page, "id").first()["last_page"]
    assert seen == list(range(1, 8))


def test_enqueue_twice(spark):
    queue = spark.createDataFrame([("a", 1, 3, 1, 5)], "username string, insert_time long, status int, attempts int, status_change long")
    asked = spark.createDataFrame([("a", 9), ("b", 8), ("b", 7)], "username string, ts long")
    got = {r["username"]: (r["insert_time"], r["status"]) for r in refresh.enqueue(queue, asked).collect()}
    assert got == {"a": (1, 3), "b": (7, 0)}


def test_scratch_tables_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_WRITTEN", [])  # those of other tests stay
    path = scratch.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert scratch.clear_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_greedy_sample_is_that_of_sets(spark):
    rng = np.random.default_rng(2)
    rows = [(u, 10**12 + int(i), 2, 5) for u in range(300) for i in rng.permutation(120)[: int(rng.integers(3, 40))]]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, status int, rating int")
    stats = S.user_stats(ratings)
    got = {(r["user_id"], r["bucket"]): r["ord"] for r in evaluate.stratified_sample(ratings, stats, 120, clusters=4).collect()}
    draw = {r["user_id"]: r["d"] for r in ratings.select("user_id", F.xxhash64("user_id", F.lit(20)).alias("d")).distinct().collect()}
    bucket = {r["user_id"]: r["b"] for r in stats.where("completed > 5").select("user_id", S.activity_bucket(F.col("completed")).alias("b")).collect()}
    lists: dict = {}
    for u, i, *_ in rows:
        lists.setdefault(u, set()).add(i)
    placed = []
    for b in sorted(set(bucket.values())):
        opened, done = [], 0
        for u in sorted((u for u in bucket if bucket[u] == b), key=lambda u: (draw[u], u)):
            own, n = lists[u], len(lists[u])
            fit = next((k for k, (seen, _) in enumerate(opened) if len(own - seen) > max(min(0.4 * n, 5 - k), (0.23 - 0.2 * k / 4) * n)), None)
            if fit is None:
                if len(opened) == 4:
                    continue
                fit = len(opened)
                opened.append((set(), []))
            opened[fit][0].update(own)
            opened[fit][1].append(u)
            if len(opened[fit][0]) > 0.95 * 120:
                placed.append((done, b, opened.pop(fit)[1]))
                done += 1
        placed += [(done + k, b, members) for k, (_, members) in enumerate(opened)]
    order = [(u, b) for _, b, members in sorted(placed, key=lambda x: x[:2]) for u in sorted(members)]
    assert got == {x: k for k, x in enumerate(order, 1)}


def test_distinct_by_bitmap(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 10**12), ("b", 1), ("b", 40000), ("b", 0)], "g string, n long")
    assert {r["g"]: r["n"] for r in evaluate.distinct_by_bitmap(rows, "n", "g").collect()} == {"a": 2, "b": 3, None: 4}
    assert evaluate.distinct_by_bitmap(rows.limit(0), "n", "g").first()["n"] == 0


def test_cleared_scratch_forgets_the_fits(spark):
    memory = scratch.forget_on_clear({})
    memory["x"] = scratch.materialize(spark.range(3), "x")
    scratch.clear_scratch(spark)
    assert memory == {}
