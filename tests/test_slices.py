"""Lists that meet in broadcast slices: the rows of brute force, and no shuffle of what two lists make together."""

import glob
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegraph.operators.queries import QUERIES
from tastegraph.plans.scratch import materialize
from tastegraph.plans.slices import best_maxima, best_sums, half_up

SMALL = "/root/testdata/sf0.01"


def shuffled(spark, run) -> int:
    """Rows that the stages of ``run`` wrote to shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    store = sc._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    seen = stages()
    last = max([seen.apply(i).stageId() for i in range(seen.size())], default=-1)
    sc.setJobGroup(group, group)
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    new = stages()
    return sum(s.shuffleWriteRecords() for s in (new.apply(i) for i in range(new.size())) if s.stageId() > last)


def test_shuffle_files_go_with_the_table(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(os.path.join(root, "**", "shuffle_*.data"), recursive=True))
    before = files()
    rows = materialize(spark.range(1000).repartition(8, "id").groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert not files() - before
    assert rows.count() == 7


@pytest.mark.parametrize("wide", [1, 1 << 55])
def test_best_of_lists_as_by_brute_force(spark, wide):
    draw = np.random.default_rng(3)
    mine = sorted({(int(a), int(b)) for a, b in draw.integers(0, [40, 30], (500, 2))})
    theirs = sorted({(int(a), int(b)) for a, b in draw.integers(0, [30, 60], (700, 2))})
    skip = sorted({(int(a), int(b)) for a, b in draw.integers(0, [40, 60], (300, 2))})
    val = {(a, b): (a * 7 + b * 3) % 11 - 4 for a, b in mine + theirs}
    lists = spark.createDataFrame([(a, b, float(val[a, b]), b) for a, b in mine], "id long, key long, val double, place int")
    other = spark.createDataFrame([(a, b * wide, float(val[a, b])) for a, b in theirs], "key long, other long, val double")
    away = spark.createDataFrame([(a, b * wide) for a, b in skip], "id long, key long")
    made = {}
    for a, key in mine:
        for k, b in theirs:
            if k == key and (a, b) not in set(skip):
                made.setdefault(a, {}).setdefault(b * wide, []).append(val[a, key] * val[k, b])
    for how, run in ((sum, lambda: best_sums(lists.drop("place"), other, 5, lambda x, y: [x * y], lambda v, w, s: s, "sums", away, 6, 64)), (max, lambda: best_maxima(lists, other, 5, lambda x, y: x * y, "maxima", away, 6, 64))):
        want = {(a, rk, b, float(how(of[b]))) for a, of in made.items() for rk, b in enumerate(sorted(of, key=lambda b: (-how(of[b]), b))[:5], 1)}
        assert {(r["id"], r["rk"], r["other"], r["score"]) for r in run().collect()} == want


def test_rounding_is_that_of_decimals(spark):
    x = [0.5, 1.0000000005, 2.5e-9, -2.5e-9, 1.4999999995, -1.0000000015, 0.1234567895, 1 / 3, -1e-12]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9) + 0.0).collect()]
    assert half_up(np.array(x), 9).tolist() == want


#: Rows that a query on the smallest tables but one may shuffle; each shuffled the rows that two lists make together before.
MOST = {
    "recommend_from_users": 1_200_000,
    "recommend_in_progress": 500_000,
    "user_pearson": 400_000,
    "co_occurrence": 230_000,
    "tagged_recommendations": 900_000,
}


def test_rounds_of_a_fit_leave_no_shuffles(spark):
    from tastegraph.operators import factors

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(os.path.join(root, "**", "shuffle_*.data"), recursive=True))
    rows = spark.range(6000).select((F.col("id") % 300).alias("user_id"), (F.col("id") * 7 % 411).alias("item_id"), (F.col("id") % 5 - 2.0).alias("norm"))
    made = []
    for rounds in (3, 9):
        before = size()
        factors.fit_als(rows, 8, 0.1, rounds)
        made.append(size() - before)
    assert made[1] < 1.5 * made[0] + 200_000


@pytest.mark.parametrize("name", MOST)
def test_what_lists_make_together_is_not_shuffled(spark, name):
    rows = shuffled(spark, lambda: QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save())
    print(name, rows)
    assert rows < MOST[name]
