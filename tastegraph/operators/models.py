"""Item-item models and the recommenders that use them.

Item models pair a user's items only within that user, each unordered pair once; their cost is
the sum of squared list lengths, which stays bounded where the ratings are those of ``active``
users. Scores are positive, the best first. ``by`` names the columns that tell lists apart:
users, or held-out cases of users.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.functions.scores import SCALE
from tastegraph.operators import similarity
from tastegraph.operators.views import COMPLETED, PLANNED, WATCHING, finished, known, old
from tastegraph.plans.numbering import numbered
from tastegraph.plans.scratch import materialize
from tastegraph.plans.slices import best_maxima, best_sums

#: Decimals at which float sums are compared, so that their order of addition does not decide a rank.
DIGITS = 9


def top_k(df: DataFrame, by: str | list[str], score: str, tie: str, k: int, name: str = "rk") -> DataFrame:
    """The best ``k`` rows of each ``by`` with their place."""
    order = W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def one_per_group(neighbours: DataFrame, groups: DataFrame) -> DataFrame:
    """A ranked list without the item's own group and with one item of each other group; places are not refilled."""
    own = groups.select(F.col("item_id"), F.col("group_id").alias("own"))
    other = groups.select(F.col("item_id").alias("similar_id"), F.col("group_id").alias("g"))
    near = neighbours.join(own, "item_id", "left").join(other, "similar_id", "left")
    first = F.row_number().over(W.partitionBy("item_id", "g").orderBy("rk"))
    kept = near.where(F.coalesce(F.col("own") != F.col("g"), F.lit(True))).withColumn("seen", first)
    return kept.where(F.col("g").isNull() | (F.col("seen") == 1)).select("item_id", "rk", "similar_id", "score")


def active(stats: DataFrame, users: DataFrame) -> DataFrame:
    """``user_id`` of users with a name whose number of finished items lies between 5 and 500."""
    return stats.where("completed > 5 and completed < 500").join(users.where("username <> ''").select("user_id"), "user_id", "left_semi").select("user_id")


def test_users(stats: DataFrame, users: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """``n`` users with a name, 11 to 99 finished items and no place in the ``sample`` that models are built on; least ids first."""
    fit = stats.where("completed > 10 and completed < 100").join(users.where("username <> ''").select("user_id", "username"), "user_id").join(sample.select("user_id"), "user_id", "left_anti")
    return fit.select("user_id", "username", "completed").orderBy("user_id").limit(n)


def co_occurrence(scored: DataFrame, groups: DataFrame, candidates: DataFrame | None = None, threshold: float = 0.3, alpha: float = 0.7, k: int = 30) -> DataFrame:
    """``item_id, rk, similar_id, score``: items liked by the same users, weighted against popular ones.

    ``candidates`` (user_id, item_id) pairs replace the liked items on the similar side, for items in progress.
    """
    liked = materialize(scored.where(F.col("q") >= math.ceil(threshold * SCALE)).select("user_id", "item_id"), "liked")
    weight = liked.groupBy("user_id").agg((1 / F.sqrt(F.count(F.lit(1)))).alias("w"))
    often = liked.groupBy("item_id").agg(F.count(F.lit(1)).alias("f"))
    right = (liked if candidates is None else candidates).select("user_id", F.col("item_id").alias("similar_id"))
    if candidates is None:
        right = right.join(often.select(F.col("item_id").alias("similar_id"), F.col("f").cast("double").alias("weight")), "similar_id")
    else:
        right = right.join(often.select(F.col("item_id").alias("similar_id"), F.col("f").cast("double").alias("weight")), "similar_id", "left")
    lists = liked.join(weight, "user_id").join(often, "item_id").select(F.col("item_id").alias("id"), F.col("user_id").alias("key"), F.col("w").alias("val"), F.col("f").alias("weight"), F.col("item_id").alias("own"))
    other = right.select(F.col("user_id").alias("key"), F.col("similar_id").alias("other"), F.lit(1.0).alias("val"), F.coalesce("weight", F.lit(float("nan"))).alias("weight"))
    score = lambda f, g, raw: np.where(np.isnan(g), raw, raw / (f * g**alpha))
    near = best_sums(lists, other, k, lambda w, one: [w * one], score, "co-occurrence", digits=DIGITS)
    return one_per_group(near.select(F.col("id").alias("item_id"), "rk", F.col("other").alias("similar_id"), "score"), groups)


def item_cosine(scored: DataFrame, k: int = 30, groups: DataFrame | None = None) -> DataFrame:
    """Exact cosine of the items' rating columns, which random projection estimates."""
    rows = scored.where("q <> 0").select("user_id", "item_id", "q")
    norm = rows.groupBy("item_id").agg(F.sum(F.col("q").cast("long") * F.col("q")).alias("weight"))
    rows = materialize(rows.join(norm, "item_id"), "rated")
    lists = rows.select(F.col("item_id").alias("id"), F.col("user_id").alias("key"), F.col("q").alias("val"), "weight", F.col("item_id").alias("own"))
    near = best_sums(lists, rows.select(F.col("user_id").alias("key"), F.col("item_id").alias("other"), F.col("q").alias("val"), "weight"), k, _product, _cosine, "item-cosine", digits=DIGITS)
    near = near.select(F.col("id").alias("item_id"), "rk", F.col("other").alias("similar_id"), "score")
    return near if groups is None else one_per_group(near, groups)


def _product(q: np.ndarray, q2: np.ndarray) -> list[np.ndarray]:
    return [q.astype(np.int64) * q2]


def _cosine(nn: np.ndarray, mm: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """Cosine of each pair; nan where a list has no norm."""
    return np.where((nn > 0) & (mm > 0), dot / np.sqrt(nn.astype(float) * mm), np.nan)


def _compared(scored: DataFrame, stats: DataFrame, weight: DataFrame) -> DataFrame:
    """``user_id, item_id, q, completed, weight`` of users who can be compared at all."""
    return materialize(similarity._lists(scored, stats).join(weight, "user_id").withColumn("completed", F.col("completed").cast("long")), "lists")


def _nearest(left: DataFrame, right: DataFrame, k: int, products: Callable, score: Callable, name: str) -> DataFrame:
    """``user_id, rk, other_id, score``: the best of ``right`` for each list of ``left (.., own)``, among users of like activity."""
    lists = left.select(F.col("user_id").alias("id"), F.col("item_id").alias("key"), F.col("q").alias("val"), "weight", F.col("completed").alias("count"), "own")
    other = right.select(F.col("item_id").alias("key"), F.col("user_id").alias("other"), F.col("q").alias("val"), "weight", F.col("completed").alias("count"))
    near = best_sums(lists, other, k, products, score, name, digits=DIGITS)
    return near.select(F.col("id").alias("user_id"), "rk", F.col("other").alias("other_id"), "score")


def _of(rows: DataFrame, targets: DataFrame | None) -> DataFrame:
    left = rows if targets is None else rows.join(targets.select("user_id").distinct(), "user_id", "left_semi")
    return left.withColumn("own", F.col("user_id"))


def user_cosine(scored: DataFrame, stats: DataFrame, targets: DataFrame | None = None, k: int = 100) -> DataFrame:
    """``user_id, rk, other_id, score``: the nearest users of each target (everyone, if None), by cosine over finished and dropped items.

    Pairs of unlike activity never meet. ``similarity.pruned_user_cosine`` gives the same rows where lists share popular items.
    """
    rows = _compared(scored, stats, similarity.norms(scored).withColumnRenamed("nn", "weight"))
    return _nearest(_of(rows, targets), rows, k, _product, _cosine, "near")


def case_cosine(case_scored: DataFrame, case_stats: DataFrame, owners: DataFrame, scored: DataFrame, stats: DataFrame, k: int = 100) -> DataFrame:
    """As user_cosine for lists that are cases of users: ``owners (user_id, own)`` names the user of each, who is no neighbour of it."""
    left = _compared(case_scored, case_stats, similarity.norms(case_scored).withColumnRenamed("nn", "weight")).join(owners, "user_id")
    return _nearest(left, _compared(scored, stats, similarity.norms(scored).withColumnRenamed("nn", "weight")), k, _product, _cosine, "near")


def user_pearson(scored: DataFrame, stats: DataFrame, targets: DataFrame | None = None, min_common: int = 20, k: int = 100) -> DataFrame:
    """As user_cosine, with norms over the common items; both lists must share ``min_common`` percent."""

    def products(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x, y = x.astype(np.int64), y.astype(np.int64)
        return [np.ones(len(x), np.int64), x * y, x * x, y * y]

    def score(la: np.ndarray, lb: np.ndarray, n: np.ndarray, xy: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
        fit = (xx > 0) & (yy > 0) & (100 * n // la >= min_common) & (100 * n // lb >= min_common)
        return np.where(fit, xy / np.sqrt(xx.astype(float) * yy), np.nan)

    rows = _compared(scored, stats, scored.groupBy("user_id").agg(F.count(F.lit(1)).alias("weight")))
    return _nearest(_of(rows, targets), rows, k, products, score, "near")


def recommend_from_users(neighbours: DataFrame, scored: DataFrame, ratings: DataFrame, restricted: DataFrame | None = None, k: int = 100) -> DataFrame:
    """``user_id, rk, item_id, score``: what each target's nearest users finished and the target does not know.

    An item liked by a neighbour counts the norm times the neighbour's score, one not liked a
    fixed -0.5; of several neighbours the best counts.
    """
    liked = scored.where(F.col("status") == COMPLETED)
    if restricted is not None:
        liked = liked.join(restricted.select("item_id"), "item_id", "left_anti")
    lists = neighbours.select(F.col("user_id").alias("id"), F.col("other_id").alias("key"), F.col("score").alias("val"), F.col("rk").alias("place"))
    other = liked.select(F.col("user_id").alias("key"), F.col("item_id").alias("other"), F.col("norm").alias("val"))
    worth = lambda score, norm: np.where(norm >= 0, norm * score, -0.5)
    return _named(best_maxima(lists, other, k, worth, "recommended", skip=_skipped(ratings), digits=DIGITS))


def _skipped(ratings: DataFrame) -> DataFrame:
    return known(ratings).select(F.col("user_id").alias("id"), F.col("item_id").alias("key"))


def _named(best: DataFrame) -> DataFrame:
    return best.select(F.col("id").alias("user_id"), "rk", F.col("other").alias("item_id"), "score")


def recommend_in_progress(neighbours: DataFrame, ratings: DataFrame, items: DataFrame, as_of: int, k: int = 100) -> DataFrame:
    """Items that nearest users are watching, by the sum of the users' scores, less those known to the target, restricted, finished or old.

    An item that the catalogue lacks stays.
    """
    drop = items.where(F.col("restricted") | finished(as_of) | old(as_of)).select("item_id")
    watching = ratings.where(F.col("status") == WATCHING).join(drop, "item_id", "left_anti")
    lists = neighbours.select(F.col("user_id").alias("id"), F.col("other_id").alias("key"), F.col("score").alias("val"))
    other = watching.select(F.col("user_id").alias("key"), F.col("item_id").alias("other"), F.lit(1.0).alias("val"))
    return _named(best_sums(lists, other, k, lambda score, one: [score * one], lambda own, theirs, total: total, "in-progress", skip=_skipped(ratings), digits=6))


def liked_best(scored: DataFrame, likes: int = 20, by: tuple[str, ...] = ("user_id",), seed: int | None = None) -> DataFrame:
    """``by, item_id, q`` of each list's ``likes`` best items; with a ``seed``, a drawn half to all of them."""
    best = top_k(scored.select(*by, "item_id", "q"), list(by), "q", "item_id", likes, "place")
    if seed is None:
        return best
    drawn = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(*by, "item_id", F.lit(seed)), "item_id"))
    return best.withColumn("_draw", drawn).where(F.col("_draw") <= likes // 2 + F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(likes // 2 + 1))).drop("_draw")


def recommend_from_items(
    scored: DataFrame, ratings: DataFrame, model: DataFrame, restricted: DataFrame | None = None, likes: int = 20, k: int = 100, by: tuple[str, ...] = ("user_id",), seed: int | None = None
) -> DataFrame:
    """Votes of each list's ``likes`` best items for their neighbours in ``model``, summed in whole billionths; known and ``restricted`` items are left out."""
    best, out = materialize(liked_best(scored, likes, by, seed).select(*by, "item_id", "q"), "likes"), known(ratings, by)
    if by != ("user_id",):
        named = numbered(best.select(*by).distinct(), [F.shiftright(by[0], 8)], [F.col(c) for c in by], "id")
        named = materialize(named, "lists")
        best, out = best.join(named, list(by)), out.join(named, list(by))
    else:
        named, best, out = None, best.withColumn("id", F.col("user_id")), out.withColumn("id", F.col("user_id"))
    votes = model if restricted is None else model.join(restricted.select(F.col("item_id").alias("similar_id")), "similar_id", "left_anti")
    other = votes.select(F.col("item_id").alias("key"), F.col("similar_id").alias("other"), F.round(F.col("score") * 1e9).cast("long").alias("val"))
    lists = best.select("id", F.col("item_id").alias("key"), F.col("q").alias("val"))
    found = best_sums(lists, other, k, _product, lambda own, theirs, total: total / (SCALE * 1e9), "votes", skip=out.select("id", F.col("item_id").alias("key")))
    return _named(found) if named is None else found.join(named, "id").select(*by, "rk", F.col("other").alias("item_id"), "score")


def similar_items(done: DataFrame, now: DataFrame, shown: DataFrame, n_done: int = 15, n_now: int = 5) -> DataFrame:
    """``item_id, kind, rk, similar_id, score``: the best neighbours of each shown item in the two models, and of those the ones that may be shown."""
    first = done.where(F.col("rk") <= n_done).withColumn("kind", F.lit("finished")).unionByName(now.where(F.col("rk") <= n_now).withColumn("kind", F.lit("in progress")))
    ids = shown.select("item_id")
    fit = first.join(ids, "item_id", "left_semi").join(ids.withColumnRenamed("item_id", "similar_id"), "similar_id", "left_semi")
    return fit.select("item_id", "kind", "rk", "similar_id", "score")


def tagged(recommended: DataFrame, ratings: DataFrame, groups: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """``tag`` for each row: planned items, items of known or planned groups, and repeats of a group in the list."""
    g = groups.select("item_id", "group_id")
    with_group = ratings.join(g, "item_id")
    plan = ratings.where(F.col("status") == PLANNED).select(*by, "item_id", F.lit(True).alias("planned"))
    known_groups = with_group.where(F.col("status") != PLANNED).select(*by, "group_id").distinct().withColumn("kg", F.lit(True))
    plan_groups = with_group.where(F.col("status") == PLANNED).select(*by, "group_id").distinct().withColumn("pg", F.lit(True))
    rows = recommended.join(g, "item_id", "left").join(plan, [*by, "item_id"], "left").join(known_groups, [*by, "group_id"], "left").join(plan_groups, [*by, "group_id"], "left")
    again = F.col("group_id").isNotNull() & (F.row_number().over(W.partitionBy(*by, "group_id").orderBy("rk")) > 1)
    tag = (
        F.when(F.col("planned") & F.col("kg"), "planned-and-group")
        .when(F.col("planned"), "planned")
        .when(F.col("kg"), "group")
        .when(F.col("pg"), "planned-group")
        .when(again, "same-group")
    )
    return rows.select(*by, "rk", "item_id", "score", tag.alias("tag"))


def client_view(tagged_rows: DataFrame, included: tuple[str, ...] = ("planned",), local: DataFrame | None = None, blocked: tuple[int, ...] = ()) -> DataFrame:
    """Rows without a tag or with an ``included`` one, less items of the client's own list ``(user_id, item_id)`` and ``blocked`` ids."""
    rows = tagged_rows.where(F.col("tag").isNull() | F.col("tag").isin(*included))
    if local is not None:
        rows = rows.join(local.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return rows.where(~F.col("item_id").isin(*blocked)) if blocked else rows


def in_catalogue(lists: DataFrame, shown: DataFrame, statuses: tuple[int, ...] | None = None) -> DataFrame:
    """Ratings of items that may be shown, of the given ``statuses`` where there are any."""
    kept = lists.join(shown.select("item_id"), "item_id", "left_semi")
    return kept if statuses is None else kept.where(F.col("status").isin(*statuses))


def without(ratings: DataFrame, held: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Ratings less the ``held`` items of each list; statistics are to be taken of what is left."""
    return ratings.join(held.select(*by, "item_id"), [*by, "item_id"], "left_anti")
