"""Nearest users, exactly: a band join for like activity, and an inverted index with prefixes.

Users are compared only if their numbers of finished items are near each other. Bands of those
numbers are wide enough that two such users lie in one band or in neighbouring ones, so a join on
(item, band) lets no others meet, and no join compares by inequality alone.

The pruned search first gives every user a floor, the k-th best score among some users that
share the user's rarest items. A partner above the floor must share an item of the user's prefix:
the items, rarest first, up to the point from which on what is left cannot add up to the floor.
What the rest can add is bounded by the norms (Cauchy-Schwarz) and by the largest weight that any
comparable user gives to each item. So popular items, which stand last, make pairs only for those
who need them. Partial products over the prefix are whole numbers; pairs whose product and
bound stay under the floor fall away, and only the others get the rest of their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.functions.scores import similar_activity
from tastegraph.plans.scratch import materialize

#: Rows of an (item, band) list that meet another such list in one task at most; longer lists are cut.
CHUNK = 2000
#: Rounding of scores: bounds are loosened by it.
SLACK = 1e-8


def band(completed: Column) -> Column:
    """Band of a number of finished items: users of like activity are at most one band apart."""
    return F.when(completed > 0, F.greatest(F.lit(0), F.floor(F.log2(completed.cast("double"))) - 2)).cast("int")


def near_bands(completed: Column) -> Column:
    """The bands in which users of like activity lie."""
    b = band(completed)
    return F.when(completed > 0, F.array(b - 1, b, b + 1))


def alike(a: DataFrame, b: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows of ``a (completed, ..)`` and ``b (completed_b, ..)`` of like activity that agree in ``keys``."""
    left = a.withColumn("_band", F.explode(near_bands(F.col("completed"))))
    right = b.withColumn("_band", band(F.col("completed_b"))).where("_band is not null")
    return left.join(right, [*keys, "_band"]).where(similar_activity(F.col("completed"), F.col("completed_b"))).drop("_band")


def _lists(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """``user_id, item_id, q, completed`` of users who can be compared at all."""
    return scored.select("user_id", "item_id", "q").join(stats.where("completed > 0").select("user_id", "completed"), "user_id")


def _cut(rows: DataFrame, long: DataFrame, parts: str, salt: str, spread: bool = False) -> DataFrame:
    """``rows`` with the part of their (item, band) list that they are in, or with every one (``spread``); only ``long`` lists have several."""
    n = F.coalesce("parts", F.lit(1))
    part = F.explode(F.sequence(F.lit(0), n - 1)) if spread else F.pmod(F.xxhash64(salt), n).cast("int")
    return rows.join(long, ["item_id", "_band"], "left").withColumn(parts, part).drop("parts")


def item_pairs(left: DataFrame, right: DataFrame, chunk: int = CHUNK, once: bool = False, own: str = "user_id") -> DataFrame:
    """``user_id, other_id, item_id, q, q2`` for each item that a user of ``left`` and another of like activity in ``right`` have.

    ``own`` is the column of ``left`` that names a list's owner in ``right``, where lists are cases of users.

    A list of more than ``chunk`` users is dealt into parts, and the rows that meet it go to each
    of them. With ``once``, each pair comes in one direction only.
    """
    others = right.select(F.col("user_id").alias("other_id"), "item_id", F.col("q").alias("q2"), F.col("completed").alias("completed_b")).withColumn("_band", band(F.col("completed_b")))
    # Lists that are too long are few: rows over ``chunk`` at most.
    long = others.groupBy("item_id", "_band").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")).where("parts > 1")
    mine = left.select("user_id", "item_id", "q", "completed", F.col(own).alias("_own")).withColumn("_band", F.explode(near_bands(F.col("completed"))))
    met = _cut(mine, long, "_part", "user_id", True).join(_cut(others, long, "_part", "other_id"), ["item_id", "_band", "_part"])
    differ = F.col("_own") < F.col("other_id") if once else F.col("_own") != F.col("other_id")
    return met.where(differ & similar_activity(F.col("completed"), F.col("completed_b"))).select("user_id", "other_id", "item_id", F.col("q").cast("long").alias("q"), F.col("q2").cast("long").alias("q2"))


def norms(scored: DataFrame) -> DataFrame:
    return scored.groupBy("user_id").agg(F.sum(F.col("q").cast("long") * F.col("q")).alias("nn")).where("nn > 0")


def cosine(dot: str, nn: str = "nn", mm: str = "mm") -> Column:
    return F.col(dot) / F.sqrt(F.col(nn).cast("double") * F.col(mm))


def _scored_pairs(dots: DataFrame, norm: DataFrame, digits: int) -> DataFrame:
    both = dots.join(norm, "user_id").join(norm.select(F.col("user_id").alias("other_id"), F.col("nn").alias("mm")), "other_id")
    return both.select("user_id", "other_id", F.round(cosine("dot"), digits).alias("score"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("score"), "other_id")
    return pairs.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("user_id", "rk", "other_id", "score")


def _rest(pairs: DataFrame, rows: DataFrame, tail: DataFrame) -> DataFrame:
    """``user_id, other_id, dot``: ``pairs (.., dot)`` with the products over the items of ``tail (user_id, item_id, q)`` added."""
    more = pairs.select("user_id", "other_id").join(tail, "user_id").join(rows.select(F.col("user_id").alias("other_id"), "item_id", F.col("q").alias("q2")), ["other_id", "item_id"])
    more = more.select("user_id", "other_id", (F.col("q").cast("long") * F.col("q2")).alias("dot"))
    return pairs.select("user_id", "other_id", "dot").unionByName(more).groupBy("user_id", "other_id").agg(F.sum("dot").alias("dot"))


def pruned_user_cosine(scored: DataFrame, stats: DataFrame, k: int = 100, digits: int = 9, probe: int | None = None, chunk: int = CHUNK) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(``user_id, rk, other_id, score``, stages): the nearest users of everyone, as from all pairs.

    ``probe`` (four times ``k``) is how many partners the search for a floor asks for. Users without
    ``k`` partners above zero have no floor and meet everyone. Stages are the pairs made on the way.
    """
    probe = probe or 4 * k
    rows, norm = materialize(_lists(scored, stats), "lists"), materialize(norms(scored), "norms")
    others = rows.join(norm, "user_id").withColumn("_band", band(F.col("completed")))
    lists = others.groupBy("item_id", "_band").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("q") / F.sqrt("nn")).alias("most"))
    # A user's lists are those of three bands; their sizes order the items, the largest weight in them bounds a product.
    own = rows.join(norm, "user_id").select("user_id", "item_id", "q", "completed", "nn", F.explode(near_bands(F.col("completed"))).alias("_band"))
    known = own.join(lists, ["item_id", "_band"]).groupBy("user_id", "item_id", "q", "completed", "nn").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    order = W.partitionBy("user_id").orderBy("n", "item_id")
    after = W.partitionBy("user_id").orderBy(F.desc("n"), F.desc("item_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    w = F.col("q") / F.sqrt("nn")
    # What an item and all later ones can add to a cosine at most, and what those after it can.
    ordered = known.withColumns({
        "met": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"),
        "left": F.least(F.sqrt(F.sum(w * w).over(after)), F.sum(F.abs(w) * F.col("most")).over(after)),
    })
    ordered = materialize(ordered.withColumn("then", F.coalesce(F.lead("left").over(order), F.lit(0.0))), "ordered")

    first = ordered.where(F.col("met") < probe)
    made = item_pairs(first, rows, chunk)
    part = materialize(made.groupBy("user_id", "other_id").agg(F.sum(F.col("q") * F.col("q2")).alias("dot")), "probed")
    hopeful = part.join(norm, "user_id").join(norm.select(F.col("user_id").alias("other_id"), F.col("nn").alias("mm")), "other_id").withColumn("score", cosine("dot"))
    hopeful = _best(hopeful, 2 * k).join(part, ["user_id", "other_id"]).select("user_id", "other_id", "dot")
    tail = ordered.where(F.col("met") >= probe).select("user_id", "item_id", "q")
    sure = _best(_scored_pairs(_rest(hopeful, rows, tail), norm, digits), k)
    floors = materialize(sure.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where((F.col("n") == k) & (F.col("floor") > 0)).select("user_id", "floor"), "floors")

    rich = ordered.join(floors, "user_id")
    needed = (F.col("left") >= F.col("floor") - SLACK)
    second = rich.where(needed & (F.col("met") >= probe))
    more = item_pairs(second, rows, chunk)
    partial = part.join(floors.select("user_id"), "user_id", "left_semi").unionByName(more.groupBy("user_id", "other_id").agg(F.sum(F.col("q") * F.col("q2")).alias("dot"))).groupBy("user_id", "other_id").agg(F.sum("dot").alias("dot"))
    # Items behind both the probe and the prefix are the rest of a user's product.
    unread = rich.where(~needed & (F.col("met") >= probe))
    bound = unread.groupBy("user_id").agg(F.max("left").alias("rest"))
    open_pairs = partial.join(norm, "user_id").join(norm.select(F.col("user_id").alias("other_id"), F.col("nn").alias("mm")), "other_id").join(floors, "user_id").join(bound, "user_id", "left")
    open_pairs = materialize(open_pairs.where(cosine("dot") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor") - SLACK).select("user_id", "other_id", "dot"), "survivors")
    exact = _scored_pairs(_rest(open_pairs, rows, unread.select("user_id", "item_id", "q")), norm, digits)

    poor = rows.join(floors, "user_id", "left_anti")
    all_pairs = item_pairs(poor, rows, chunk)
    rest = _scored_pairs(all_pairs.groupBy("user_id", "other_id").agg(F.sum(F.col("q") * F.col("q2")).alias("dot")), norm, digits)
    return _best(exact.unionByName(rest), k), {"probed": made, "prefix": more, "survivors": open_pairs, "without floor": all_pairs}
