"""Canonical views over the driver's tables: ratings, items and their side tables, users, edges, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.plans.numbering import numbered

WATCHING, COMPLETED, ON_HOLD, DROPPED, PLANNED = 1, 2, 3, 4, 6
IN_PROGRESS, FINISHED = 1, 2
SPECIAL, RESTRICTED_GENRE = 4, 12
DAY = 86400
#: The "now" of registered queries: 1998-01-01.
AS_OF = 883612800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, item_id, status, rating``; one row for each pair."""
    status = (
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), DROPPED)
        .when((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "A"), COMPLETED)
        .when(F.col("l_returnflag") == "N", WATCHING)
        .otherwise(PLANNED)
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), status.alias("status"), "l_quantity", "l_discount")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    rated = F.when((F.col("l_discount") == 0) | (F.col("status") == PLANNED), 0).otherwise(F.ceil(F.col("l_quantity") / 5)).cast("int")
    return lines.join(orders, "l_orderkey").withColumn("rating", rated).groupBy("user_id", "item_id").agg(F.min("status").alias("status"), F.max("rating").alias("rating"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, title, genre, type, status, episodes, start_at, end_at, image, restricted, group_id, rank``."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    groups = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("group_id"))
    ranked = numbered(part, [-F.col("p_retailprice"), F.shiftright("p_partkey", 20)], [-F.col("p_retailprice"), F.col("p_partkey")], "rank")
    day = F.col("p_partkey") * 7919 % 2600
    return ranked.join(groups, ["p_name", "p_brand"]).select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.col("p_type").alias("genre"),
        (1 + F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 6).alias("type"),
        F.when(size % 10 == 0, IN_PROGRESS).otherwise(FINISHED).alias("status"),
        size.alias("episodes"),
        F.when(size % 17 != 0, 694224000 + day * DAY).alias("start_at"),
        F.when((size % 17 != 0) & (size % 9 != 0), 694224000 + (day + size * 6) * DAY).alias("end_at"),
        F.when(size % 11 == 0, "").otherwise(F.concat(F.lit("https://img.example/"), "p_partkey", F.lit(".jpg"))).alias("image"),
        (size == 13).alias("restricted"),
        "group_id",
        F.col("rank").cast("int").alias("rank"),
    )


def other_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, title, image``: the catalogue of the other kind."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("title"), F.concat(F.lit("https://img.example/o"), "s_suppkey", F.lit(".jpg")).alias("image"))


def finished(as_of: int) -> Column:
    """Whether an item is finished, or in progress with an end that is still to come."""
    return (F.col("status") == FINISHED) | ((F.col("status") == IN_PROGRESS) & (F.coalesce("end_at", F.lit(0)) >= as_of))


def in_progress(as_of: int) -> Column:
    return (F.col("status") == IN_PROGRESS) & ~finished(as_of)


def old(as_of: int) -> Column:
    """Whether an item began over a year ago; one without a start did."""
    return as_of - F.coalesce("start_at", F.lit(0)) > 365 * DAY


def catalogue(all_items: DataFrame) -> DataFrame:
    """Items that may be shown: neither restricted nor specials."""
    return all_items.where(~F.col("restricted") & (F.col("type") != SPECIAL))


def genre_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``genre, description``: the kinds of parts, numbered from 21, five sizes from 40, and the restricted genre."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("description")).distinct()
    kinds = kinds.select((20 + F.row_number().over(W.orderBy("description"))).alias("genre"), "description")
    fixed = [(40 + k, f"Size {k}") for k in range(5)] + [(RESTRICTED_GENRE, "Restricted")]
    return kinds.unionByName(spark.createDataFrame(fixed, "genre int, description string"))


def item_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, genre_id, sort_order``."""
    part, names = table(spark, sf_dir, "part"), genre_names(spark, sf_dir)
    kind = part.join(F.broadcast(names), F.col("p_type") == F.col("description")).select(F.col("p_partkey").alias("item_id"), F.col("genre").alias("genre_id"), F.lit(0).alias("sort_order"))
    size = part.select(F.col("p_partkey").alias("item_id"), (40 + F.col("p_size") % 5).alias("genre_id"), F.lit(1).alias("sort_order"))
    bad = part.where("p_size = 13").select(F.col("p_partkey").alias("item_id"), F.lit(RESTRICTED_GENRE).alias("genre_id"), F.lit(2).alias("sort_order"))
    return kind.unionByName(size).unionByName(bad)


def alternate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, title_type, title``: 1 for translated titles, 2 for synonyms."""
    part = table(spark, sf_dir, "part")
    english = part.where("p_size > 25").select(F.col("p_partkey").alias("item_id"), F.lit(1).alias("title_type"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("title"))
    return english.unionByName(part.where("p_size <= 10").select(F.col("p_partkey").alias("item_id"), F.lit(2).alias("title_type"), F.col("p_name").alias("title")))


def titles(shown: DataFrame, alternates: DataFrame) -> DataFrame:
    """``item_id, title_id, title``: each item's distinct titles of both tables, numbered within the item by text."""
    every = shown.select("item_id", "title").union(alternates.join(shown.select("item_id"), "item_id", "left_semi").select("item_id", "title")).distinct()
    return every.select("item_id", (F.row_number().over(W.partitionBy("item_id").orderBy("title")) - 1).alias("title_id"), "title")


def details(all_items: DataFrame) -> DataFrame:
    """``item_id, rank, popularity, score``; the smallest items have none."""
    return all_items.where("episodes > 3").select("item_id", "rank", (F.col("rank") * 3 % 1000).alias("popularity"), (600 + F.col("item_id") % 300).cast("int").alias("score"))


def details_update(all_items: DataFrame) -> DataFrame:
    """``item_id, last_update`` of items whose details were ever fetched."""
    return all_items.where("episodes > 5").select("item_id", (AS_OF - F.col("item_id") * 37 % 40 * DAY).alias("last_update"))


def image_cache(all_items: DataFrame) -> DataFrame:
    """``url, expires, etag, cached_path, sizes``."""
    some = all_items.where("episodes > 8 and image <> ''")
    tag = F.concat(F.lit("e"), F.col("item_id"))
    return some.select(F.col("image").alias("url"), (AS_OF + (F.col("item_id") % 21 - 10) * DAY).alias("expires"), tag.alias("etag"), F.concat(F.lit("img/"), tag, F.lit(".jpg")).alias("cached_path"), F.lit("84x114,168x228").alias("sizes"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, username, last_update, last_change, last_item_change, last_other_change``; some names are blank."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderstatus", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"))
    done = orders.groupBy("user_id").agg(
        F.max("t").alias("last_change"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("t"))).alias("last_item_change"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("t"))).alias("last_other_change")
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("username"))
    return people.join(done, "user_id").select("user_id", "username", (F.col("last_change") + F.col("user_id") % 20 * DAY).alias("last_update"), "last_change", F.coalesce("last_item_change", F.lit(0)).alias("last_item_change"), F.coalesce("last_other_change", F.lit(0)).alias("last_other_change"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``a, b``: neighbouring parts of one name and brand."""
    order = W.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select(F.lag("p_partkey").over(order).alias("a"), F.col("p_partkey").alias("b")).where("a is not null")


def known(r: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Pairs that a user has in any status but planned."""
    return r.where(F.col("status") != PLANNED).select(*by, "item_id")


RATINGS_SQL = """rows0 AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity, l_discount,
  CASE WHEN l_linestatus='F' AND l_returnflag='R' THEN 4 WHEN l_linestatus='F' THEN 2 WHEN l_returnflag='A' THEN 2 WHEN l_returnflag='N' THEN 1 ELSE 6 END AS status
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
ratings AS (SELECT user_id, item_id, min(status)::INT AS status, max(CASE WHEN l_discount=0 OR status=6 THEN 0 ELSE ceil(l_quantity/5) END)::INT AS rating FROM rows0 GROUP BY ALL)"""
ITEMS_SQL = """items AS (SELECT p_partkey AS item_id, p_name||' '||p_brand AS title, p_type AS genre, (1+regexp_extract(p_brand,'[0-9]+')::INT%6)::INT AS type, CASE WHEN p_size%10=0 THEN 1 ELSE 2 END AS status, p_size AS episodes,
  CASE WHEN p_size%17<>0 THEN 694224000+(p_partkey*7919%2600)*86400 END AS start_at, CASE WHEN p_size%17<>0 AND p_size%9<>0 THEN 694224000+(p_partkey*7919%2600+p_size*6)*86400 END AS end_at,
  CASE WHEN p_size%11=0 THEN '' ELSE 'https://img.example/'||p_partkey||'.jpg' END AS image, p_size=13 AS restricted,
  min(p_partkey) OVER (PARTITION BY p_name,p_brand) AS group_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM part)"""
OTHER_ITEMS_SQL = "others AS (SELECT s_suppkey AS item_id, s_name AS title, 'https://img.example/o'||s_suppkey||'.jpg' AS image FROM supplier)"
SHOWN_SQL = "shown AS (SELECT * FROM items WHERE NOT restricted AND type<>4)"
GENRES_SQL = """genre_names AS (SELECT (20+row_number() OVER (ORDER BY description))::INT AS genre, description FROM (SELECT DISTINCT p_type AS description FROM part) UNION ALL SELECT (40+k)::INT, 'Size '||k FROM range(5) t(k) UNION ALL SELECT 12, 'Restricted'),
item_genres AS (SELECT p_partkey AS item_id, genre AS genre_id, 0 AS sort_order FROM part JOIN genre_names ON description=p_type UNION ALL SELECT p_partkey, 40+p_size%5, 1 FROM part UNION ALL SELECT p_partkey, 12, 2 FROM part WHERE p_size=13)"""
ALTERNATES_SQL = "alternates AS (SELECT p_partkey AS item_id, 1 AS title_type, lower(p_type)||' '||p_name AS title FROM part WHERE p_size>25 UNION ALL SELECT p_partkey, 2, p_name FROM part WHERE p_size<=10)"
TITLES_SQL = f"{SHOWN_SQL}, {ALTERNATES_SQL}, titles AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY title)-1)::INT AS title_id, title FROM (SELECT item_id, title FROM shown UNION SELECT item_id, title FROM alternates WHERE item_id IN (SELECT item_id FROM shown)))"
SIDE_SQL = """details AS (SELECT item_id, rank, (rank*3%1000)::INT AS popularity, (600+item_id%300)::INT AS score FROM items WHERE episodes>3),
updates AS (SELECT item_id, 883612800-item_id*37%40*86400 AS last_update FROM items WHERE episodes>5),
images AS (SELECT image AS url, 883612800+(item_id%21-10)*86400 AS expires, 'e'||item_id AS etag, 'img/e'||item_id||'.jpg' AS cached_path, '84x114,168x228' AS sizes FROM items WHERE episodes>8 AND image<>'')"""
USERS_SQL = """users AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal<0 THEN '' ELSE c_name END AS username, last_change+c_custkey%20*86400 AS last_update, last_change, coalesce(i,0)::BIGINT AS last_item_change, coalesce(o,0)::BIGINT AS last_other_change FROM customer JOIN
  (SELECT o_custkey, max(epoch(o_orderdate))::BIGINT AS last_change, max(epoch(o_orderdate)) FILTER (o_orderstatus='F') AS i, max(epoch(o_orderdate)) FILTER (o_orderstatus='O') AS o FROM orders GROUP BY 1) ON o_custkey=c_custkey)"""
