"""Registered queries over the store: side tables, pages by key, change rules, readers and writers, factor models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import attach, evaluate, factors, models
from tastegraph.operators import views as V
from tastegraph.operators.recommend import recommend, recommend_drawn, recommend_in_progress
from tastegraph.operators.registry import AIRING_MODEL_SQL, BASE_SQL, COOC_SQL, MODEL_SQL, QUEUE_SQL, RECS_SQL, TAG_SQL, Views, query, votes_sql
from tastegraph.operators.views import ALTERNATES_SQL, AS_OF, DAY, GENRES_SQL, ITEMS_SQL, OTHER_ITEMS_SQL, RATINGS_SQL, SHOWN_SQL, SIDE_SQL, TITLES_SQL, USERS_SQL
from tastegraph.plans.scratch import forget_on_clear, materialize, scratch_path
from tastegraph.sources import lists, models as stored, pages, textmodels
from tastegraph.streaming import changes, refresh, store

STORE_SQL = f"WITH {ITEMS_SQL}, {SHOWN_SQL}, {SIDE_SQL}, {USERS_SQL}, {OTHER_ITEMS_SQL}"


#: A later "now" for users, whose last changes lie in 1998: 1999-01-01.
YEAR_END = 915148800


# ---- side tables and pages -------------------------------------------------------------


@query(f"{STORE_SQL} SELECT i.item_id, i.image, etag, expires, cached_path FROM items i LEFT JOIN images c ON c.url=i.image")
def items_with_images(v: Views) -> DataFrame:
    return attach.with_images(v.items, V.image_cache(v.items)).select("item_id", "image", "etag", "expires", "cached_path")


@query(f"{STORE_SQL} SELECT item_id, coalesce(last_update,1)::BIGINT AS last_update FROM items LEFT JOIN updates USING (item_id)")
def item_update_times(v: Views) -> DataFrame:
    return attach.with_update_times(v.items, V.details_update(v.items))


@query(f"WITH {RATINGS_SQL}, {USERS_SQL}, st AS (SELECT user_id, count(*) FILTER (status=1) AS w, count(*) FILTER (status=2) AS c, count(*) FILTER (status=6) AS p FROM ratings GROUP BY 1), sizes AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1), o AS (SELECT user_id, count(*) AS done FROM events WHERE event_type='purchase' GROUP BY 1) SELECT u.user_id, username, last_change, w AS stats_watching, c AS stats_completed, p AS stats_planned, n AS list_n, done AS other_done FROM users u LEFT JOIN st USING (user_id) LEFT JOIN sizes USING (user_id) LEFT JOIN o USING (user_id)")
def users_with_side_tables(v: Views) -> DataFrame:
    stats = lists.list_counts(v.ratings).select("user_id", "watching", "completed", "planned")
    other = v.t("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("done"))
    size = v.ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return attach.with_side_tables(v.users.select("user_id", "username", "last_change"), stats=stats, list=size, other=other)


@query(f"{STORE_SQL} SELECT i.item_id, title, d.rank, popularity, score, last_update FROM items i JOIN details d USING (item_id) JOIN updates USING (item_id)")
def detailed_items(v: Views) -> DataFrame:
    return attach.detailed(v.items, V.details(v.items), V.details_update(v.items)).select("item_id", "title", "rank", "popularity", "score", "last_update")


@query(f"""WITH {ITEMS_SQL}, {ALTERNATES_SQL}, {GENRES_SQL} SELECT item_id, coalesce((SELECT string_agg(title_type||':'||title, '|' ORDER BY title_type, title) FROM alternates a WHERE a.item_id=i.item_id),'') AS titles,
  coalesce((SELECT string_agg(genre_id||'@'||sort_order, '|' ORDER BY sort_order, genre_id) FROM item_genres g WHERE g.item_id=i.item_id),'') AS genres FROM items i""")
def items_with_lists(v: Views) -> DataFrame:
    alt, genres = V.alternate_titles(v.spark, v.d), V.item_genres(v.spark, v.d)
    full = attach.attached(v.items.select("item_id"), titles=(alt, ["title_type", "title"]), genres=(genres, ["sort_order", "genre_id"]))
    text = lambda c, f: F.array_join(F.transform(c, f), "|")
    return full.select("item_id", text("titles", lambda t: F.concat_ws(":", t["title_type"], t["title"])).alias("titles"), text("genres", lambda g: F.concat_ws("@", g["genre_id"], g["sort_order"])).alias("genres"))


@query(f"WITH {ITEMS_SQL}, {GENRES_SQL} SELECT DISTINCT item_id, title FROM items JOIN item_genres USING (item_id) WHERE genre_id=12")
def restricted_items(v: Views) -> DataFrame:
    return attach.restricted_by_genre(v.items, V.item_genres(v.spark, v.d), V.RESTRICTED_GENRE).select("item_id", "title")


@query(f"WITH {GENRES_SQL} SELECT item_id, string_agg(description, ', ' ORDER BY sort_order, description) AS genres FROM item_genres JOIN genre_names ON genre=genre_id GROUP BY 1")
def genre_descriptions(v: Views) -> DataFrame:
    return attach.genre_lists(V.item_genres(v.spark, v.d), V.genre_names(v.spark, v.d))


@query(f"WITH {USERS_SQL}, asked AS (SELECT DISTINCT upper(c_name) AS asked FROM customer UNION SELECT 'nobody '||c_custkey FROM customer WHERE c_nationkey=0) SELECT asked, coalesce(u.username, asked) AS name FROM asked LEFT JOIN users u ON lower(u.username)=lower(asked) AND u.username<>''")
def stored_names(v: Views) -> DataFrame:
    c = v.t("customer")
    asked = c.select(F.upper("c_name").alias("asked")).union(c.where("c_nationkey = 0").select(F.concat_ws(" ", F.lit("nobody"), "c_custkey"))).distinct()
    return attach.by_name(v.users, asked, "username")


@query(f"{STORE_SQL}, page AS (SELECT item_id, coalesce(last_update,1)::BIGINT AS last_update FROM items LEFT JOIN updates USING (item_id) WHERE item_id>40 ORDER BY item_id LIMIT 100) SELECT item_id, last_update, (SELECT coalesce(max(item_id),-1) FROM page) AS last_page FROM page")
def update_times_page(v: Views) -> DataFrame:
    page = attach.key_page(attach.with_update_times(v.items, V.details_update(v.items)), "item_id", 40, 100)
    return page.join(F.broadcast(attach.page_end(page, "item_id")), F.lit(True))


@query(f"WITH {ITEMS_SQL} SELECT group_id, sum(episodes)::BIGINT AS episodes FROM items GROUP BY 1")
def group_episodes(v: Views) -> DataFrame:
    return attach.group_units(v.items)


@query(f"""{RECS_SQL}, {TAG_SQL}, {GENRES_SQL}, eps AS (SELECT group_id, sum(episodes)::BIGINT AS n FROM items GROUP BY 1), names AS (SELECT item_id, string_agg(description, ', ' ORDER BY sort_order, description) AS genres FROM item_genres JOIN genre_names ON genre=genre_id GROUP BY 1)
SELECT user_id, rk, title, genres, n AS episodes, CASE WHEN start_at IS NULL THEN 'Unknown season' ELSE CASE WHEN month(t)<=3 THEN 'Winter' WHEN month(t)<=6 THEN 'Spring' WHEN month(t)<=9 THEN 'Fall' ELSE 'Winter' END||' '||year(t) END AS season, tag
FROM (SELECT *, make_timestamp((start_at+32400)*1000000) AS t FROM tagged JOIN items USING (item_id)) JOIN names USING (item_id) JOIN eps USING (group_id)""")
def rendered_items(v: Views) -> DataFrame:
    """What a client is shown of each recommendation."""
    rows = models.tagged(v.recs(), v.ratings, v.items).join(v.items.select("item_id", "title", "group_id", "start_at"), "item_id")
    full = rows.join(attach.genre_lists(V.item_genres(v.spark, v.d), V.genre_names(v.spark, v.d)), "item_id").join(attach.group_units(v.items), "group_id")
    return full.select("user_id", "rk", "title", "genres", "episodes", S.season(F.col("start_at")).alias("season"), "tag")


@query(f"{RECS_SQL}, {TAG_SQL} SELECT t.user_id, t.rk, t.item_id, t.tag FROM tagged t LEFT JOIN (SELECT user_id, item_id FROM ratings WHERE status=6 AND item_id>500) l ON l.user_id=t.user_id AND l.item_id=t.item_id WHERE l.item_id IS NULL AND (tag IS NULL OR tag IN ('planned','planned-group')) AND t.item_id NOT IN (7,77)")
def client_recommendations(v: Views) -> DataFrame:
    local = v.ratings.where("status = 6 and item_id > 500")
    return models.client_view(models.tagged(v.recs(), v.ratings, v.items), ("planned", "planned-group"), local, (7, 77)).select("user_id", "rk", "item_id", "tag")


@query(f"WITH {RATINGS_SQL}, {ITEMS_SQL}, {SHOWN_SQL} SELECT user_id, item_id, status, 'all' AS variant FROM ratings WHERE item_id IN (SELECT item_id FROM shown) UNION ALL SELECT user_id, item_id, status, 'seen' FROM ratings WHERE item_id IN (SELECT item_id FROM shown) AND status IN (1,2,4)")
def catalogue_lists(v: Views) -> DataFrame:
    every = models.in_catalogue(v.ratings, v.shown).withColumn("variant", F.lit("all"))
    return every.unionByName(models.in_catalogue(v.ratings, v.shown, (1, 2, 4)).withColumn("variant", F.lit("seen"))).select("user_id", "item_id", "status", "variant")


@query(f"WITH {ITEMS_SQL} SELECT item_id, status=2 OR (status=1 AND coalesce(end_at,0)>={AS_OF}) AS finished, status=1 AND coalesce(end_at,0)<{AS_OF} AS in_progress, {AS_OF}-coalesce(start_at,0)>365*86400 AS old FROM items")
def item_states(v: Views) -> DataFrame:
    return v.items.select("item_id", V.finished(AS_OF).alias("finished"), V.in_progress(AS_OF).alias("in_progress"), V.old(AS_OF).alias("old"))


@query(f"WITH {ITEMS_SQL}, {TITLES_SQL} SELECT item_id, title_id, title FROM titles")
def search_titles(v: Views) -> DataFrame:
    return v.titles()


@query(f"{BASE_SQL}, sample AS (SELECT user_id FROM stats ORDER BY completed DESC, user_id LIMIT 100) SELECT user_id, username, completed FROM stats JOIN users USING (user_id) WHERE completed>10 AND completed<100 AND username<>'' AND user_id NOT IN (SELECT user_id FROM sample) ORDER BY user_id LIMIT 40")
def evaluation_users(v: Views) -> DataFrame:
    sample = v.stats.orderBy(F.desc("completed"), "user_id").limit(100)
    return models.test_users(v.stats, v.users, sample, 40)


@query(f"{MODEL_SQL}, {AIRING_MODEL_SQL}, {SHOWN_SQL} SELECT item_id, kind, rk, similar_id, score FROM (SELECT *, 'finished' AS kind FROM cooc WHERE rk<=15 UNION ALL SELECT *, 'in progress' FROM air WHERE rk<=5) WHERE item_id IN (SELECT item_id FROM shown) AND similar_id IN (SELECT item_id FROM shown)")
def similar_items(v: Views) -> DataFrame:
    return models.similar_items(v.settle().model(), v.model_in_progress(), v.shown)


# ---- change rules ------------------------------------------------------------------------


@query(f"{STORE_SQL} SELECT i.item_id, i.title, i.episodes FROM (SELECT item_id, title, CASE WHEN episodes>45 THEN episodes+1 ELSE episodes END AS episodes, end_at FROM items) i JOIN items o USING (item_id) WHERE (i.title, i.episodes) IS DISTINCT FROM (o.title, o.episodes) UNION ALL SELECT item_id+1000000000, title, 1 FROM others")
def changed_items(v: Views) -> DataFrame:
    old = v.items.select("item_id", "title", "episodes", "end_at")
    new = old.withColumn("episodes", F.when(F.col("episodes") > 45, F.col("episodes") + 1).otherwise(F.col("episodes")))
    more = V.other_items(v.spark, v.d).select((F.col("item_id") + 1_000_000_000).alias("item_id"), "title", F.lit(1).alias("episodes"), F.lit(None).cast("long").alias("end_at"))
    return changes.changed_rows(new.unionByName(more), old, "item_id").select("item_id", "title", "episodes")


SEEN_SQL = "seen AS (SELECT user_id, 'n'||user_id AS username, max(CASE WHEN event_type='error' THEN 0 ELSE floor(epoch(ts)) END)::BIGINT AS change FROM events WHERE user_id%5<4 GROUP BY 1)"


@query(f"WITH {USERS_SQL}, {SEEN_SQL} SELECT user_id, coalesce(s.username,u.username) AS username, CASE WHEN change IS NOT NULL THEN {AS_OF} ELSE last_update END AS last_update, CASE WHEN coalesce(change,0)<>0 THEN greatest(change, coalesce(last_other_change,0)) ELSE last_change END AS last_change, CASE WHEN coalesce(change,0)<>0 THEN change ELSE last_item_change END AS last_item_change, last_other_change FROM users u FULL JOIN seen s USING (user_id)")
def users_after_update(v: Views) -> DataFrame:
    e = v.t("events").where("user_id % 5 < 4")
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    seen = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", 0).otherwise(t)).alias("change")).select("user_id", F.concat(F.lit("n"), "user_id").alias("username"), "change")
    return changes.with_change_times(v.users, seen, AS_OF)


@query(f"WITH {USERS_SQL}, tries AS (SELECT user_id, max(floor(epoch(ts)))::BIGINT AS tried FROM events WHERE event_type='view' GROUP BY 1) SELECT user_id, last_update>{AS_OF}-21600 OR (last_update>0 AND coalesce(tried,0)>0) AS fresh FROM users LEFT JOIN tries USING (user_id)")
def fresh_users(v: Views) -> DataFrame:
    tries = v.t("events").where("event_type = 'view'").groupBy("user_id").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("tried"))
    return v.users.join(tries, "user_id", "left").select("user_id", changes.fresh(F.col("last_update"), F.coalesce("tried", F.lit(0)), AS_OF).alias("fresh"))


@query(f"{STORE_SQL} SELECT item_id, title, last_update FROM items LEFT JOIN updates USING (item_id) WHERE last_update IS NULL OR last_update<{AS_OF}-15*86400 ORDER BY last_update NULLS FIRST, item_id LIMIT 30")
def stale_items(v: Views) -> DataFrame:
    return changes.stale_items(v.items, V.details_update(v.items), AS_OF)


@query(f"{STORE_SQL} SELECT image AS url, etag, expires FROM (SELECT image FROM items UNION ALL SELECT image FROM others) LEFT JOIN images ON url=image WHERE image<>'' AND (expires IS NULL OR expires<{AS_OF}) ORDER BY expires NULLS FIRST, image LIMIT 30")
def stale_images(v: Views) -> DataFrame:
    return changes.stale_images([v.items, V.other_items(v.spark, v.d)], V.image_cache(v.items), AS_OF)


@query(f"WITH {USERS_SQL} SELECT (({YEAR_END}-min(last_change))//86400)::BIGINT AS days FROM users WHERE last_change>{YEAR_END}-15552000")
def quietest_day(v: Views) -> DataFrame:
    return changes.quietest_day(v.users, YEAR_END)


@query(f"""WITH {USERS_SQL}, q AS (SELECT ({YEAR_END}-min(last_change))//86400 AS days FROM users WHERE last_change>{YEAR_END}-15552000), b AS (SELECT k, 10+pow(1.1::DOUBLE,k) AS lo, 10+pow(1.1::DOUBLE,k+1) AS hi FROM range(1,301) t(k), q WHERE 10+pow(1.1::DOUBLE,k+1)<coalesce(days,0)),
act AS (SELECT user_id, username, k FROM (SELECT user_id, username, k, row_number() OVER (PARTITION BY k ORDER BY last_update, user_id) AS place FROM users, b WHERE username<>'' AND last_update<{YEAR_END}-10*86400 AND last_change>={YEAR_END}-hi*86400 AND last_change<{YEAR_END}-lo*86400) WHERE place<=10)
SELECT user_id, username, k::INT AS bucket FROM act UNION ALL SELECT user_id, username, 0 FROM (SELECT *, row_number() OVER (ORDER BY last_update, user_id) AS place FROM users WHERE username<>'' AND last_change<{YEAR_END}-15552000) WHERE place<=greatest(20, floor((SELECT count(*) FROM act)*0.1::DOUBLE))""")
def users_to_refresh(v: Views) -> DataFrame:
    return changes.users_to_refresh(v.users, YEAR_END)


@query("""WITH ch AS (SELECT user_id, (event_id%17)::BIGINT AS item_id, (event_id%10+1)::INT AS rating, event_type='error' AS removed, event_id AS pos FROM events), g AS (SELECT *, max(CASE WHEN removed THEN pos END) OVER (PARTITION BY user_id, item_id) AS gone FROM ch),
one AS (SELECT user_id, item_id, min(pos) AS first, arg_max(rating, pos) AS rating FROM g WHERE NOT removed AND (gone IS NULL OR pos>gone) GROUP BY 1,2) SELECT user_id, item_id, 2 AS status, rating, row_number() OVER (PARTITION BY user_id ORDER BY first DESC, item_id)::INT AS place FROM one""")
def local_lists(v: Views) -> DataFrame:
    e = v.t("events").select("user_id", (F.col("event_id") % 17).alias("item_id"), (F.col("event_id") % 10 + 1).cast("int").alias("rating"), (F.col("event_type") == "error").alias("removed"), F.col("event_id").alias("at"))
    return changes.latest_local(e)


@query(f"{STORE_SQL}, pulled AS (SELECT item_id, 1 AS rank, 2 AS popularity, 900 AS score, CASE WHEN episodes>40 THEN 1 ELSE {AS_OF} END AS last_update FROM items WHERE episodes>30) SELECT item_id, rank, popularity, score FROM details WHERE item_id NOT IN (SELECT item_id FROM pulled WHERE last_update<>1) UNION ALL SELECT item_id, rank, popularity, score FROM pulled WHERE last_update<>1")
def details_after_pull(v: Views) -> DataFrame:
    pulled = v.items.where("episodes > 30").select("item_id", F.lit(1).alias("rank"), F.lit(2).alias("popularity"), F.lit(900).alias("score"), F.when(F.col("episodes") > 40, 1).otherwise(AS_OF).alias("last_update"))
    return changes.stored_details(v.items, V.details(v.items), pulled)


@query(f"{QUEUE_SQL}, asked AS (SELECT 'u'||user_id AS username, min(floor(epoch(ts)))::BIGINT AS ts FROM events WHERE event_type='click' GROUP BY 1 UNION ALL SELECT 'w'||user_id, min(floor(epoch(ts)))::BIGINT FROM events WHERE event_type='signup' GROUP BY 1), q AS (SELECT * FROM queue UNION ALL SELECT username, ts, 0, 0, ts FROM asked WHERE username NOT IN (SELECT username FROM queue)) SELECT a.username, 1+(SELECT count(*) FROM q b WHERE b.status=0 AND b.insert_time<a.insert_time) AS position FROM q a WHERE status=0")
def queue_after_requests(v: Views) -> DataFrame:
    e = v.t("events").withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp")))
    asked = e.where("event_type = 'click'").select(F.concat(F.lit("u"), "user_id").alias("username"), "ts").union(e.where("event_type = 'signup'").select(F.concat(F.lit("w"), "user_id"), "ts"))
    return refresh.positions(refresh.enqueue(v.queue(), asked))


@query("SELECT DISTINCT 'u'||o_custkey AS username FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def new_names(v: Views) -> DataFrame:
    """Names seen that the store lacks."""
    seen = v.t("orders").select(F.concat(F.lit("u"), "o_custkey").alias("username")).distinct()
    return seen.join(v.t("events").select(F.concat(F.lit("u"), "user_id").alias("username")), "username", "left_anti")


@query(f"WITH {USERS_SQL}, mine AS (SELECT user_id, username, last_change-CASE WHEN user_id%3=0 THEN 100 ELSE 0 END AS last_change FROM users WHERE user_id%7<>0), theirs AS (SELECT user_id, upper(username) AS username, last_change-CASE WHEN user_id%3=1 THEN 100 ELSE 0 END AS last_change FROM users) SELECT user_id, CASE WHEN m.last_change IS NULL OR t.last_change>m.last_change THEN t.username ELSE m.username END AS username, coalesce(greatest(m.last_change, t.last_change), t.last_change)::BIGINT AS last_change FROM theirs t LEFT JOIN mine m USING (user_id)")
def users_after_pull(v: Views) -> DataFrame:
    """Two copies of the users, each ahead of the other for a third of them and one without a seventh, after one pulls from the other."""
    behind = lambda k: F.col("last_change") - F.when(F.col("user_id") % 3 == k, 100).otherwise(0)
    mine = v.users.where("user_id % 7 <> 0").select("user_id", "username", behind(0).alias("last_change"))
    theirs = v.users.select("user_id", F.upper("username").alias("username"), behind(1).alias("last_change"))
    return refresh.pulled(mine, theirs, "user_id", "last_change")


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT l_partkey AS item_id, arg_max('v'||l_orderkey||'.'||l_linenumber, struct_pack(t:=epoch(l_shipdate)::BIGINT, o:=l_orderkey, n:=l_linenumber)) AS title, max(epoch(l_shipdate))::BIGINT AS t FROM lineitem GROUP BY 1) SELECT item_id, coalesce(c.title,i.title) AS title, coalesce(t,0)::BIGINT AS "at" FROM items i LEFT JOIN c USING (item_id)""")
def stored_upserts(v: Views) -> DataFrame:
    """Items in a stored table after a stream of changes, each order line one, was applied to it by batches."""
    folder = scratch_path(v.spark, "upserts")
    schema = "item_id long, title string, at long"
    table = store.BucketedTable(v.spark, f"{folder}/items", "item_id", schema, 16).create(v.items.select("item_id", "title", F.lit(0).cast("long").alias("at")))
    full = f"{schema}, l_orderkey long, l_linenumber int"
    at = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    changes_of = v.t("lineitem").select(F.col("l_partkey").alias("item_id"), F.concat(F.lit("v"), "l_orderkey", F.lit("."), "l_linenumber").alias("title"), at.alias("at"), "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))
    changes_of.repartitionByRange(4, "at").write.parquet(f"{folder}/changes")
    rows = v.spark.readStream.schema(full).option("maxFilesPerTrigger", 2).parquet(f"{folder}/changes")
    store.upsert_stream(rows, table, ["at", "l_orderkey", "l_linenumber"], f"{folder}/at", newer="at").awaitTermination()
    return table.rows()


@query(f"WITH {USERS_SQL}, mine AS (SELECT user_id, username, last_change-CASE WHEN user_id%3=0 THEN 100 ELSE 0 END AS last_change FROM users WHERE user_id%7<>0), theirs AS (SELECT user_id, CASE WHEN user_id%3=2 THEN username ELSE upper(username) END AS username, last_change-CASE WHEN user_id%3=1 THEN 100 ELSE 0 END AS last_change FROM users WHERE user_id%11<>0), every AS (SELECT * FROM mine UNION ALL SELECT * FROM theirs), newest AS (SELECT user_id, arg_max(username, last_change) AS username, max(last_change) AS last_change FROM every GROUP BY 1) SELECT side, user_id, username, last_change FROM newest, (VALUES ('here'), ('there')) s(side)")
def two_way_sync(v: Views) -> DataFrame:
    """Two stored copies of the users, each ahead for a third of them and short of some, after a pass each way."""
    folder, schema = scratch_path(v.spark, "sync"), "user_id long, username string, last_change long"
    behind = lambda k: (F.col("last_change") - F.when(F.col("user_id") % 3 == k, 100).otherwise(0)).alias("last_change")
    name = F.when(F.col("user_id") % 3 == 2, F.col("username")).otherwise(F.upper("username")).alias("username")
    here = store.BucketedTable(v.spark, f"{folder}/here", "user_id", schema, 8).create(v.users.where("user_id % 7 <> 0").select("user_id", "username", behind(0)))
    there = store.BucketedTable(v.spark, f"{folder}/there", "user_id", schema, 8).create(v.users.where("user_id % 11 <> 0").select("user_id", name, behind(1)))
    store.sync(here, there, "last_change", store.Marks(v.spark, f"{folder}/out"))
    store.sync(there, here, "last_change", store.Marks(v.spark, f"{folder}/in"))
    return here.rows().withColumn("side", F.lit("here")).unionByName(there.rows().withColumn("side", F.lit("there")))


# ---- readers and writers -------------------------------------------------------------------


DAYS_SQL = "dated AS (SELECT user_id, item_id, status, rating, CASE WHEN status IN (2,4) THEN 10000+item_id%500 ELSE 0 END::INT AS day FROM ratings)"


def _dated(v: Views) -> DataFrame:
    return v.ratings.withColumn("day", S.day_of((10000 + F.col("item_id") % 500) * DAY, F.col("status")).cast("int"))


@query(f"WITH {RATINGS_SQL}, {DAYS_SQL} SELECT user_id, item_id, status, rating, day FROM dated")
def packed_lists_round_trip(v: Views) -> DataFrame:
    return lists.read_packed(lists.write_packed(_dated(v))).select("user_id", "item_id", "status", "rating", "day")


@query(f"WITH {RATINGS_SQL} SELECT user_id, count(*) AS n, min(item_id) AS first, max(item_id) AS last, sum(rating)::BIGINT AS total FROM ratings GROUP BY 1")
def request_bodies(v: Views) -> DataFrame:
    body = lists.write_lists(v.ratings).select("user_id", F.concat(F.lit('{"animeList": '), "list", F.lit(', "more": 1}')).alias("body"))
    e = body.select("user_id", lists.read_request(F.col("body")).alias("l"))
    return e.select("user_id", F.size("l").cast("long").alias("n"), F.element_at("l", 1)["item_id"].alias("first"), F.element_at("l", -1)["item_id"].alias("last"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["rating"]).alias("total"))


@query(f"{BASE_SQL} SELECT user_id, item_id, i.title, i.type, episodes AS units, r.status, rating, 10000+item_id AS last_updated FROM ratings r JOIN items i USING (item_id)")
def xml_dumps(v: Views) -> DataFrame:
    """Users' lists written as XML dumps and read back."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{name}>"))
    c = F.col
    parts = [tag("series_animedb_id", c("item_id")), tag("series_title", c("title")), tag("series_type", c("type")), tag("series_episodes", c("episodes")), tag("my_status", c("r_status")), tag("my_score", c("rating")), tag("my_last_updated", c("item_id") + 10000)]
    rows = v.ratings.withColumnRenamed("status", "r_status").join(v.items, "item_id").select("user_id", "item_id", F.concat(F.lit("<anime>"), *parts, F.lit("</anime>")).alias("x"))
    bodies = rows.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "x"))), lambda e: e["x"]), "\u0001").alias("b"))
    xml = bodies.select(F.concat(F.lit("<dump><myinfo>"), tag("user_id", c("user_id")), F.lit("<user_name>x</user_name></myinfo>"), "b", F.lit("</dump>")).alias("xml"))
    return lists.read_xml_dump(xml).select("user_id", "item_id", "title", "type", "units", "status", "rating", "last_updated")


@query(f"WITH {ITEMS_SQL} SELECT item_id, title, type, episodes AS units, CASE WHEN start_at IS NULL THEN '0000-00-00' ELSE strftime(make_timestamp(start_at*1000000),'%Y-%m-%d') END AS start, CASE WHEN image='' THEN '' ELSE 'https://cdn.example/images/anime/1/'||item_id||'.jpg' END AS image, 7 AS rating, 2 AS status FROM items")
def list_pages(v: Views) -> DataFrame:
    """Items written as JSON list pages and read back."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("TV", "OVA", "Movie", "Special", "ONA", "Music")]), F.col("type"))
    start = F.date_format(F.timestamp_seconds("start_at"), "MM-dd-yy")
    image = F.when(F.col("image") == "", "https://cdn.example/images/qm_50.gif").otherwise(F.concat(F.lit("https://cdn.example/r/96x136/images/anime/1/"), "item_id", F.lit(".jpg?s=1")))
    one = F.struct(F.col("item_id").alias("anime_id"), F.col("title").alias("anime_title"), kind.alias("anime_media_type_string"), F.col("episodes").alias("anime_num_episodes"), F.col("status").alias("anime_airing_status"), start.alias("anime_start_date_string"), F.lit(None).cast("string").alias("anime_end_date_string"), image.alias("anime_image_path"), F.lit(7).alias("score"), F.lit(2).alias("status"))
    page = v.items.groupBy("group_id").agg(F.to_json(F.collect_list(one)).alias("page"))
    return page.select(F.explode(lists.list_page(F.col("page"))).alias("e")).select("e.item_id", "e.title", "e.type", "e.units", "e.start", "e.image", "e.rating", "e.status")


@query(f"WITH {ITEMS_SQL}, {GENRES_SQL}, {ALTERNATES_SQL}, {SIDE_SQL} SELECT i.item_id, coalesce((SELECT string_agg(genre_id||'='||description, '|' ORDER BY sort_order, genre_id) FROM item_genres g JOIN genre_names ON genre=genre_id WHERE g.item_id=i.item_id),'') AS genres, coalesce((SELECT string_agg(title||'='||title_type, '|' ORDER BY title_type, title) FROM alternates a WHERE a.item_id=i.item_id),'') AS titles, coalesce(score,0)::INT AS score, coalesce(d.rank,0)::INT AS rank, coalesce(popularity,0)::INT AS popularity, CASE WHEN i.item_id<>group_id THEN group_id||'=5' ELSE '' END AS relations FROM items i LEFT JOIN details d USING (item_id)")
def item_pages(v: Views) -> DataFrame:
    """Items' details written as pages and read back."""
    genres = V.item_genres(v.spark, v.d).join(F.broadcast(V.genre_names(v.spark, v.d)), F.col("genre_id") == F.col("genre"))
    rows = attach.attached(v.items.select("item_id", "group_id"), g=(genres, ["sort_order", "genre_id", "description"]), t=(V.alternate_titles(v.spark, v.d), ["title_type", "title"])).join(V.details(v.items), "item_id", "left")
    link = lambda x: F.concat(F.lit("<a href='x' href=\"/anime/genre/"), x["genre_id"], F.lit("/y\">"), x["description"], F.lit("</a>, "))
    name = lambda x: F.concat(F.lit("<div><span class='dark'>"), F.when(x["title_type"] == 1, "English:").otherwise("Synonyms:"), F.lit("</span> "), x["title"], F.lit(" </div>"))
    stat = lambda c, before, after: F.when(F.col(c).isNotNull(), F.concat(F.lit(before), F.col(c), F.lit(after))).otherwise("")
    cells = F.when(F.col("item_id") != F.col("group_id"), F.concat(F.lit("<tr><td>Prequel:</td><td><a href=\"/anime/"), "group_id", F.lit("/z\">z</a></td></tr>"))).otherwise("")
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit('<div class="score">'), F.format_string("%d.%02d", F.floor(F.col("score") / 100), F.col("score") % 100), F.lit("</div>"))).otherwise("")
    html = F.concat(
        F.lit("<html><h2>Alternative Titles</h2>"), F.array_join(F.transform("t", name), ""), F.lit("<h2>Information</h2><div><span>Genres:</span> "), F.array_join(F.transform("g", link), ""), F.lit('</div><div class="stats-block">'),
        score, stat("rank", '<span class="numbers ranked">Ranked <b>#', "</b></span>"), stat("popularity", '<span class="numbers popularity">Popularity #', "</span>"), F.lit('</div><table class="anime_detail_related_anime">'), cells, F.lit("</table></html>"),
    )
    page = rows.select("item_id", pages.item_page(html).alias("p"))
    join = lambda c, f: F.array_join(F.transform(c, f), "|")
    return page.select(
        "item_id", join("p.genres", lambda g: F.concat_ws("=", g["genre_id"], g["description"])).alias("genres"), join("p.titles", lambda t: F.concat_ws("=", t["title"], t["title_type"])).alias("titles"),
        "p.scores.score", "p.scores.rank", "p.scores.popularity", join("p.relations", lambda r: F.concat_ws("=", r["related_id"], r["relation"])).alias("relations"),
    )


@query(f"WITH {USERS_SQL} SELECT user_id, username, user_id*7 AS anime_count, user_id%3 AS manga_count, last_update//60*60 AS anime_update, 0::BIGINT AS manga_update FROM users WHERE username<>''")
def profile_pages(v: Views) -> DataFrame:
    """Users' profiles written as pages and read back."""
    zone = "America/Los_Angeles"
    when = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("last_update"), zone), "MMM d, yyyy h:mm a")
    block = lambda kind, n, updates: F.concat(F.lit(f'<div class="stats {kind}"><ul class="stats-data"><li><span>Total</span> <span>'), F.format_number(n, 0), F.lit(f'</span></li></ul></div><div class="updates {kind}">'), updates, F.lit("</div>"))
    html = F.concat(
        F.lit('<div class="user-comments"><h2><a href="https://x.example/comments.php?id='), "user_id", F.lit('">c</a></h2></div><div class="user-profile"><div class="user-button"><a href="https://x.example/animelist/'), "username", F.lit('">l</a></div></div>'),
        block("anime", F.col("user_id") * 7, F.concat(F.lit('<div class="statistics"><div class="data"><div><span>'), when, F.lit("</span></div></div></div>"))), block("manga", F.col("user_id") % 3, F.lit("")),
    )
    return v.users.where("username <> ''").select(pages.profile_page(html, F.timestamp_seconds(F.lit(AS_OF)), zone).alias("p")).select("p.*")


@query("SELECT page_id, regexp_extract_all(html,'<a href=\"/([^\"]+)\"',1)[1] AS first, len(regexp_extract_all(html,'<a href=\"/([^\"]+)\"',1))::INT AS n FROM pages")
def page_names(v: Views) -> DataFrame:
    """Links of pages rewritten as profile links with a picture, read as the names of a users page."""
    html = F.regexp_replace(F.regexp_replace("html", '<a href="/([^"]+)">', '<a href="/profile/$1"><img src="x">'), '<a href="(?!/profile)[^"]*">', "<a>")
    return v.t("pages").select("page_id", pages.usernames(html).alias("n")).select("page_id", F.get("n", F.lit(0)).alias("first"), F.size("n").alias("n"))


@query(f"{MODEL_SQL} SELECT item_id, rk, similar_id, score FROM cooc")
def published_model(v: Views) -> DataFrame:
    """The co-occurrence model staged, published with its version and read back."""
    folder = scratch_path(v.spark, "models")
    stored.write_model(v.model(), folder, "co-occurrence")
    stored.publish(v.spark, folder, ["co-occurrence"])
    return stored.read_model(v.spark, folder, "co-occurrence")


@query(f"{MODEL_SQL} SELECT item_id, rk, similar_id, score FROM cooc")
def text_model(v: Views) -> DataFrame:
    """The co-occurrence model written as numbered text and read back by places; 0 is an item here, so -1 marks free ones."""
    path = scratch_path(v.spark, "text-model")
    textmodels.write_item_model(v.model(), path, "model", unused=-1)
    return textmodels.read_item_model(v.spark, path, unused=-1)


@query()
def sample_file(v: Views) -> DataFrame:
    """The first 1,000 users of the sample's text file."""
    path = scratch_path(v.spark, "sample")
    textmodels.write_sample(evaluate.stratified_sample(v.ratings, v.stats, v.items.count()), path)
    return textmodels.read_sample(v.spark, path, 1000)


# ---- factor models ---------------------------------------------------------------------------


_FITS: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = forget_on_clear({})


def _fit(v: Views) -> tuple[DataFrame, DataFrame]:
    """User and item factors of rank 40 after 24 rounds over active users and finished items; fitted once for an application and a folder."""
    key = (v.spark.sparkContext.applicationId, v.d)
    v.settle()
    if key not in _FITS:
        done = v.items.where(F.col("status") == V.FINISHED).select("item_id")
        users, items = factors.fit_als(v.fit().join(done, "item_id", "left_semi"))
        _FITS[key] = materialize(users, "als-users"), materialize(items, "als-items")
    return _FITS[key]


@query(f"{RECS_SQL} SELECT * FROM recs")
def fallback_recommendations(v: Views) -> DataFrame:
    """What the factor recommender gives while there are no factors."""
    v.settle()
    return recommend("factor-users", v.ratings, v.scored, v.stats, v.items)


@query(f"{BASE_SQL}, b AS (SELECT user_id, CASE WHEN completed<180 THEN completed//15 ELSE 8+completed//45 END AS bucket FROM stats), a AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY user_id) AS pos FROM b) SELECT user_id, bucket::BIGINT AS bucket, row_number() OVER (ORDER BY pos, bucket)::BIGINT AS turn FROM a")
def interleaved_users(v: Views) -> DataFrame:
    """Users of all activity buckets in turn."""
    rows = v.stats.select("user_id", S.activity_bucket(F.col("completed")).cast("long").alias("bucket"))
    return evaluate.interleaved(rows, "bucket", ["user_id"])


@query()
def als_recommendations(v: Views) -> DataFrame:
    users, items = _fit(v)
    some = items.join(v.shown.select(F.col("item_id").alias("id")), "id", "left_semi")
    return factors.score_items(users.withColumnRenamed("id", "user_id"), some, V.known(v.ratings))


@query()
def fold_in_recommendations(v: Views) -> DataFrame:
    """For every user, in the fit or not: factors solved from the user's own list."""
    _, items = _fit(v)
    some = items.join(v.shown.select(F.col("item_id").alias("id")), "id", "left_semi")
    return factors.score_items(factors.fold_in_users(v.scored, items), some, V.known(v.ratings))


@query()
def fold_in_recommendations_in_progress(v: Views) -> DataFrame:
    users, items = _fit(v)
    now = factors.fold_in_items(v.ratings, users, v.shown.where(V.in_progress(AS_OF) & ~V.old(AS_OF)))
    return factors.score_items(factors.fold_in_users(v.scored, items), now, V.known(v.ratings))


@query()
def als_fold_in(v: Views) -> DataFrame:
    users, _ = _fit(v)
    return factors.fold_in_items(v.ratings, users, v.items.where(F.col("status") == V.IN_PROGRESS))


@query(f"""{BASE_SQL}, {COOC_SQL}, {AIRING_MODEL_SQL}, open_air AS (SELECT * FROM air WHERE similar_id NOT IN (SELECT item_id FROM items WHERE status=2 OR (status=1 AND coalesce(end_at,0)>={AS_OF}) OR {AS_OF}-coalesce(start_at,0)>365*86400)),
{votes_sql(model="open_air")} SELECT * FROM recs WHERE rk<=10""")
def in_progress_from_items(v: Views) -> DataFrame:
    """Ten items in progress for every user, by votes of liked ones in the co-occurrence model of items in progress."""
    v.settle()
    return recommend_in_progress("co-occurrence", v.ratings, v.scored, v.stats, v.items, AS_OF, model=v.model_in_progress())


@query()
def drawn_likes(v: Views) -> DataFrame:
    """Votes of 10 to 20 drawn ones of each user's 20 best items."""
    v.settle()
    return models.recommend_from_items(v.scored, v.ratings, v.model(), v.restricted, seed=1)


@query()
def drawn_recommendations(v: Views) -> DataFrame:
    """Every user's recommendations by the method drawn for them."""
    users, items = _fit(v.settle())
    return recommend_drawn(v.ratings, v.scored, v.stats, v.items, model=v.model(), user_factors=users, item_factors=items)


@query()
def factor_item_votes(v: Views) -> DataFrame:
    """Votes of liked items for those near them in the factor space."""
    _, items = _fit(v.settle())
    return recommend("factor-items", v.ratings, v.scored, v.stats, v.items, item_factors=items)


@query()
def als_user_neighbours(v: Views) -> DataFrame:
    return factors.user_neighbours(_fit(v)[0], v.stats)


@query()
def als_user_recommendations(v: Views) -> DataFrame:
    """What users near by factor finished and a user does not know."""
    return models.recommend_from_users(factors.user_neighbours(_fit(v)[0], v.stats), v.scored, v.ratings, v.restricted)


@query()
def als_item_neighbours(v: Views) -> DataFrame:
    return factors.item_neighbours(_fit(v)[1], v.items)


@query()
def als_item_neighbours_in_progress(v: Views) -> DataFrame:
    users, items = _fit(v)
    now = factors.fold_in_items(v.ratings, users, v.items.where(F.col("status") == V.IN_PROGRESS))
    return factors.item_neighbours(items, v.items, 15, now)


@query()
def als_rmse(v: Views) -> DataFrame:
    """The error of the fit on its own ratings, over all users."""
    users, items = _fit(v)
    return factors.rmse(v.fit(), users, items, every=1)


@query()
def als_recall(v: Views) -> DataFrame:
    """Single-item recall by factors folded in from each case's list."""
    _, items = _fit(v)
    some = items.join(v.restricted.select(F.col("item_id").alias("id")), "id", "left_anti")
    cases = evaluate.Cases(v.settle().ratings, evaluate.middle_and_high(v.scored))
    return evaluate.single_item_recall(lambda c: factors.score_items(factors.fold_in_users(c.scored, items), some, V.known(c.less)), cases, v.items)


@query()
def als_hidden_rmse(v: Views) -> DataFrame:
    """The error on eight hidden items of each user with 30 finished ones."""
    v.settle()
    return factors.hidden_rmse(v.ratings, materialize(evaluate.hidden(v.scored), "hidden"))


@query()
def als_grid(v: Views) -> DataFrame:
    """The error on hidden items by rank, regularisation and rounds."""
    return factors.grid_search(v.settle().ratings, [10, 20], [0.1], 8)


@query()
def projected_item_similarity(v: Views) -> DataFrame:
    return factors.item_neighbours(factors.sign_projection(v.fit()), v.items)


@query()
def projection_stability(v: Views) -> DataFrame:
    """Share of neighbours that projections of two seeds have in common, by the number of dimensions."""
    found, none = None, v.items.select("item_id", F.lit(None).cast("long").alias("group_id"))
    for dims in (250, 1000):
        one, two = (factors.item_neighbours(factors.sign_projection(v.fit(), dims, seed), none) for seed in (1, 2))
        row = evaluate.neighbour_stability(one, two).withColumn("dims", F.lit(dims))
        found = row if found is None else found.unionByName(row)
    return found
