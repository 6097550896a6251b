"""Side tables attached to items and users, pages by key, and sums over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_images(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with what the image cache has of their image."""
    return items.join(cache.withColumnRenamed("url", "image"), "image", "left")


def with_update_times(items: DataFrame, updates: DataFrame, missing: int = 1) -> DataFrame:
    """``item_id, last_update``, with ``missing`` where an item's details were never fetched."""
    return items.select("item_id").join(updates, "item_id", "left").select("item_id", F.coalesce("last_update", F.lit(missing)).alias("last_update"))


def with_side_tables(users: DataFrame, **tables: DataFrame) -> DataFrame:
    """Users left-joined with tables keyed by ``user_id``; a table's columns take its name as a prefix."""
    for name, table in tables.items():
        users = users.join(table.select("user_id", *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "user_id"]), "user_id", "left")
    return users


def detailed(items: DataFrame, details: DataFrame, updates: DataFrame) -> DataFrame:
    """Items that have details and an update time, with both."""
    return items.drop("rank").join(details, "item_id").join(updates, "item_id")


def attached(items: DataFrame, **many: tuple[DataFrame, list[str]]) -> DataFrame:
    """Items with an array column for each one-to-many table, its rows as sorted structs; an empty array where there are none."""
    for name, (table, columns) in many.items():
        rows = table.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        kind = rows.schema[name].dataType.simpleString()
        items = items.join(rows, "item_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return items


def restricted_by_genre(items: DataFrame, genres: DataFrame, genre: int) -> DataFrame:
    """Items that have the restricted genre."""
    return items.join(genres.where(F.col("genre_id") == genre).select("item_id"), "item_id", "left_semi")


def genre_lists(genres: DataFrame, names: DataFrame) -> DataFrame:
    """``item_id, genres``: descriptions in their order; genre names are a small table."""
    named = genres.join(F.broadcast(names), F.col("genre_id") == F.col("genre"))
    return named.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "description"))), lambda x: x["description"]), ", ").alias("genres"))


def by_name(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``asked`` names with the stored spelling of the same name in any case, or as they are asked."""
    stored = rows.select(F.lower(column).alias("_low"), F.col(column).alias("_stored")).where("_stored <> ''").groupBy("_low").agg(F.min("_stored").alias("_stored"))
    return names.join(stored, F.lower("asked") == F.col("_low"), "left").select("asked", F.coalesce("_stored", "asked").alias("name"))


def key_page(rows: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The next ``n`` rows after a key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(n)


def page_end(page: DataFrame, key: str) -> DataFrame:
    """``last_page``: the largest key of a page, -1 if it is empty."""
    return page.agg(F.coalesce(F.max(key), F.lit(-1)).alias("last_page"))


def group_units(items: DataFrame) -> DataFrame:
    """``group_id, episodes``: the episodes of a group's items together."""
    return items.groupBy("group_id").agg(F.sum("episodes").alias("episodes"))
