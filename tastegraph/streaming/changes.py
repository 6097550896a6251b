"""Rules of upserts and refreshes: what has changed, when, and what is to be fetched again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86400
#: Items are fetched again after 15 days; users' lists after 10, the quietest (no change in half a year) a few at a time.
STALE, USER_AGE, QUIET = 15 * DAY, 10, 6 * 30 * DAY


def differs(columns: list[str], new: str = "new", old: str = "old") -> Column:
    """Whether any of the ``columns`` of two structs differ; nulls equal each other."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}"))
    return ~same


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has otherwise."""
    columns = [c for c in new.columns if c != key]
    both = new.select(F.col(key), F.struct(*columns).alias("new")).join(old.select(F.col(key), F.struct(*columns).alias("old"), F.lit(True).alias("there")), key, "left")
    return both.where(F.col("there").isNull() | differs(columns)).select(key, "new.*")


def with_change_times(users: DataFrame, seen: DataFrame, now: int, kind: str = "item") -> DataFrame:
    """``users`` after their lists of one ``kind`` were seen: rows ``(user_id, username, change)`` of which ``change`` 0 means no news.

    News sets the kind's time and raises the overall one to the later of the two kinds; without
    news all times stay. Unknown users are added.
    """
    other = "other" if kind == "item" else "item"
    both = seen.withColumnRenamed("username", "new_name").join(users, "user_id", "full_outer")
    here = F.col("change").isNotNull()
    news = here & (F.col("change") != 0)
    return both.select(
        "user_id", F.coalesce("new_name", "username").alias("username"), F.when(here, F.lit(now)).otherwise(F.col("last_update")).alias("last_update"),
        F.when(news, F.greatest(F.col("change"), F.coalesce(f"last_{other}_change", F.lit(0)))).otherwise(F.col("last_change")).alias("last_change"),
        F.when(news, F.col("change")).otherwise(F.col(f"last_{kind}_change")).alias(f"last_{kind}_change"), f"last_{other}_change",
    )


def fresh(last_update: Column, last_attempt: Column, now: int) -> Column:
    """Whether a user's data can be served: under six hours old, or there at all and tried again since."""
    return (last_update > now - 6 * 3600) | ((last_update > 0) & (last_attempt > 0))


def stale_items(items: DataFrame, updates: DataFrame, now: int, n: int = 30) -> DataFrame:
    """The ``n`` items whose details are missing or the oldest, missing ones first."""
    rows = items.select("item_id", "title").join(updates, "item_id", "left")
    return rows.where(F.col("last_update").isNull() | (F.col("last_update") < now - STALE)).orderBy(F.asc_nulls_first("last_update"), "item_id").limit(n)


def stale_images(items: list[DataFrame], cache: DataFrame, now: int, n: int = 30) -> DataFrame:
    """The ``n`` images of all kinds of items that are not cached or have expired, missing ones first."""
    urls = items[0].select("image")
    for more in items[1:]:
        urls = urls.unionByName(more.select("image"))
    rows = urls.where("image <> ''").join(cache, F.col("image") == F.col("url"), "left")
    return rows.where(F.col("expires").isNull() | (F.col("expires") < now)).select(F.col("image").alias("url"), "etag", "expires").orderBy(F.asc_nulls_first("expires"), "image").limit(n)


def quietest_day(users: DataFrame, now: int) -> DataFrame:
    """``days``: whole days since the oldest change of the last half year."""
    return users.where(F.col("last_change") > now - QUIET).agg(F.floor((now - F.min("last_change")) / DAY).alias("days"))


def users_to_refresh(users: DataFrame, now: int, budget: int = 10, least: int = 20, share: float = 0.1) -> DataFrame:
    """``user_id, username, bucket``: of each age bucket the ``budget`` named users that were fetched longest ago.

    Bucket k holds users who last changed between 10 + 1.1^k and 10 + 1.1^(k+1) days ago, k from 1
    up to the quietest day; bucket 0 holds those quiet for half a year, a tenth of the others'
    number and ``least`` of them at least.
    """
    most = F.coalesce(F.max("days"), F.lit(0))
    edge = quietest_day(users, now).agg(most.alias("last"))
    named = users.where("username <> ''")
    # Whole powers of 1.1 are compared as they are, so that the last digit of a logarithm decides nothing.
    powers = edge.select("last", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("k")).select("last", "k", (USER_AGE + F.pow(F.lit(1.1), F.col("k"))).alias("begin"), (USER_AGE + F.pow(F.lit(1.1), F.col("k") + 1)).alias("end"))
    # The last bucket that counts ends before the quietest day; at most some hundred rows.
    powers = powers.where("end < last")
    due = named.where(F.col("last_update") < now - USER_AGE * DAY).join(F.broadcast(powers), (F.col("last_change") >= now - F.col("end") * DAY) & (F.col("last_change") < now - F.col("begin") * DAY))
    order = W.partitionBy("k").orderBy("last_update", "user_id")
    active = due.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("user_id", "username", F.col("k").alias("bucket"))
    allowed = max(least, int(active.count() * share))
    quiet = named.where(F.col("last_change") < now - QUIET).orderBy("last_update", "user_id").limit(allowed)
    return active.unionByName(quiet.select("user_id", "username", F.lit(0).alias("bucket")))


def latest_local(lists: DataFrame, item: str = "item_id", order: str = "at") -> DataFrame:
    """A client's own list of changes ``(user_id, item, rating, removed, at)`` applied in order.

    Each item stands once, as finished, with its last rating; one whose last change removes it
    does not stand. ``place`` orders a list: an item keeps the place of its first addition since it
    was last removed, later first additions stand before earlier ones.
    """
    w = W.partitionBy("user_id", item).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = lists.withColumns({"_gone": F.max(F.when(F.col("removed"), F.col(order))).over(whole), "_last": F.max(order).over(whole)})
    rows = rows.where(~F.col("removed") & (F.col("_gone").isNull() | (F.col(order) > F.col("_gone"))))
    one = rows.groupBy("user_id", item).agg(F.min(order).alias("_first"), F.max(F.struct(order, "rating")).getField("rating").alias("rating"))
    return one.select("user_id", item, F.lit(2).alias("status"), "rating", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("_first"), item)).alias("place"))


def stored_details(items: DataFrame, details: DataFrame, pulled: DataFrame) -> DataFrame:
    """Details after a pull ``(item_id, rank, popularity, score, last_update)``: a ``last_update`` of 1 means that the other side has none, and is passed over."""
    new = pulled.where("last_update <> 1").join(items.select("item_id"), "item_id", "left_semi").select(*details.columns)
    return details.join(new, "item_id", "left_anti").unionByName(new)
