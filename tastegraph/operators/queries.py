"""Registered queries over the canonical views, each beside its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import evaluate, factors, models, search, similarity
from tastegraph.operators import views as V
from tastegraph.operators.registry import (
    AIRING_MODEL_SQL, BASE_SQL, COOC_SQL, MODEL_SQL, NEAR_SQL, ORACLE, QUERIES, QUEUE_SQL, RECS_SQL, SIMILAR_SQL, TAG_SQL, VOTES_SQL, Views, model_sql, query, scored_sql, stats_sql, tag_sql, votes_sql,
)
from tastegraph.operators.views import AS_OF, ITEMS_SQL, TITLES_SQL
from tastegraph.plans.components import connected_components
from tastegraph.plans.scratch import materialize
from tastegraph.streaming import refresh

__all__ = ["ORACLE", "QUERIES"]

@query(f"{MODEL_SQL} SELECT * FROM cooc")
def co_occurrence(v: Views) -> DataFrame:
    return v.model()


@query(f"{BASE_SQL}, {COOC_SQL}, {AIRING_MODEL_SQL} SELECT * FROM air")
def co_occurrence_in_progress(v: Views) -> DataFrame:
    return v.model_in_progress()


@query(f"{BASE_SQL} SELECT user_id, status, rating, item_id, q, round(norm,6) AS norm FROM scored")
def normalized_ratings(v: Views) -> DataFrame:
    return v.scored.select("user_id", "status", "rating", "item_id", "q", F.round("norm", 6).alias("norm"))


@query(f"{BASE_SQL} SELECT user_id, n, least, completed, dropped, round(mean,6) AS mean, round(dev,6) AS dev FROM stats")
def user_statistics(v: Views) -> DataFrame:
    return v.stats.select("user_id", "n", "least", "completed", "dropped", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"))


@query(f"{BASE_SQL} SELECT user_id, count(*) FILTER (status=1) AS watching, count(*) FILTER (status=2) AS completed, count(*) FILTER (status=3) AS onhold, count(*) FILTER (status=4) AS dropped, count(*) FILTER (status=6) AS planned FROM ratings GROUP BY 1")
def status_counts(v: Views) -> DataFrame:
    return v.ratings.groupBy("user_id").agg(*[F.count_if(F.col("status") == k).alias(n) for k, n in ((1, "watching"), (2, "completed"), (3, "onhold"), (4, "dropped"), (6, "planned"))])


@query(f"{NEAR_SQL} SELECT * FROM near")
def user_cosine(v: Views) -> DataFrame:
    return v.near()


@query(f"{NEAR_SQL} SELECT * FROM near")
def pruned_user_cosine(v: Views) -> DataFrame:
    """The rows of ``user_cosine`` by an inverted index with prefixes."""
    v.settle()
    return similarity.pruned_user_cosine(v.scored, v.stats)[0]


@query(f"""{BASE_SQL}, size AS (SELECT user_id, count(*) AS l FROM scored GROUP BY 1) SELECT user_id, rk, other_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, other_id)::INT AS rk FROM (
  SELECT d.user_id, d.other_id, round(xy/sqrt(xx::DOUBLE*yy),9) AS score FROM (SELECT x.user_id, y.user_id AS other_id, count(*) AS n, sum(x.q::BIGINT*y.q)::BIGINT AS xy, sum(x.q::BIGINT*x.q)::BIGINT AS xx, sum(y.q::BIGINT*y.q)::BIGINT AS yy FROM scored x JOIN scored y ON x.item_id=y.item_id AND x.user_id<>y.user_id GROUP BY 1,2) d
  JOIN size a ON a.user_id=d.user_id JOIN size b ON b.user_id=d.other_id JOIN stats sa ON sa.user_id=d.user_id JOIN stats sb ON sb.user_id=d.other_id
  WHERE xx>0 AND yy>0 AND (100*d.n)//a.l>=5 AND (100*d.n)//b.l>=5 AND {SIMILAR_SQL})) WHERE rk<=100""")
def user_pearson(v: Views) -> DataFrame:
    v.settle()
    return models.user_pearson(v.scored, v.stats, min_common=5)


@query(f"{RECS_SQL} SELECT * FROM recs")
def recommend_from_users(v: Views) -> DataFrame:
    return v.recs()


@query(f"""{NEAR_SQL} SELECT user_id, rk, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INT AS rk FROM (SELECT n.user_id, r.item_id, round(sum(score),6) AS score FROM near n JOIN ratings r ON r.user_id=n.other_id AND r.status=1
  LEFT JOIN items i ON i.item_id=r.item_id LEFT JOIN (SELECT user_id, item_id FROM ratings WHERE status<>6) k ON k.user_id=n.user_id AND k.item_id=r.item_id
  WHERE k.item_id IS NULL AND NOT coalesce(i.restricted OR i.status=2 OR (i.status=1 AND coalesce(end_at,0)>={AS_OF}) OR {AS_OF}-coalesce(start_at,0)>365*86400, false) GROUP BY 1,2)) WHERE rk<=100""")
def recommend_in_progress(v: Views) -> DataFrame:
    near = v.settle().near()
    return models.recommend_in_progress(near, v.ratings, v.items, AS_OF)


@query(f"{VOTES_SQL} SELECT * FROM recs")
def recommend_from_items(v: Views) -> DataFrame:
    return v.votes()


@query(f"{RECS_SQL}, {TAG_SQL} SELECT * FROM tagged")
def tagged_recommendations(v: Views) -> DataFrame:
    return models.tagged(v.recs(), v.ratings, v.items)


@query(f"{RECS_SQL}, {TAG_SQL} SELECT t.user_id, t.rk, i.title, i.genre, tag FROM tagged t JOIN items i USING (item_id) WHERE tag IS NULL OR tag='planned'")
def rendered_recommendations(v: Views) -> DataFrame:
    shown = models.tagged(v.recs(), v.ratings, v.items).where("tag is null or tag = 'planned'")
    return shown.join(v.items.select("item_id", "title", "genre"), "item_id").select("user_id", "rk", "title", "genre", "tag")


@query(f"{BASE_SQL}, " + model_sql("ic", "SELECT d.item_id, d.similar_id, round(dot/sqrt(a.n::DOUBLE*b.n),9) AS score FROM (SELECT x.item_id, y.item_id AS similar_id, sum(x.q::BIGINT*y.q)::BIGINT AS dot FROM fit x JOIN fit y ON x.user_id=y.user_id AND x.item_id<>y.item_id WHERE x.q<>0 AND y.q<>0 GROUP BY 1,2) d JOIN (SELECT item_id, sum(q::BIGINT*q)::BIGINT AS n FROM fit WHERE q<>0 GROUP BY 1) a USING (item_id) JOIN (SELECT item_id, sum(q::BIGINT*q)::BIGINT AS n FROM fit WHERE q<>0 GROUP BY 1) b ON b.item_id=d.similar_id", 30) + " SELECT * FROM ic")
def item_cosine(v: Views) -> DataFrame:
    return models.item_cosine(v.fit(), groups=v.items)


@query("WITH t AS (SELECT p_partkey AS a, lag(p_partkey) OVER (PARTITION BY p_name,p_brand ORDER BY p_partkey) AS l, lead(p_partkey) OVER (PARTITION BY p_name,p_brand ORDER BY p_partkey) AS n, min(p_partkey) OVER (PARTITION BY p_name,p_brand) AS m FROM part) SELECT a AS node, m AS component FROM t WHERE l IS NOT NULL OR n IS NOT NULL")
def item_groups(v: Views) -> DataFrame:
    return connected_components(V.edges(v.spark, v.d))


@query(f"{RECS_SQL}, {TAG_SQL} SELECT planned, total, round(planned/total,6) AS share FROM (SELECT count(*) FILTER (tag IN ('planned','planned-group')) AS planned, count(*) AS total FROM tagged WHERE rk<=40 AND user_id IN (SELECT user_id FROM ratings WHERE status=6 GROUP BY 1 HAVING count(*) BETWEEN 5 AND 20))")
def planned_recall(v: Views) -> DataFrame:
    """Over users with 5 to 20 planned items; the given lists are shorter than those of the 30 to 100 by default."""
    return evaluate.planned_recall(models.tagged(v.recs(), v.ratings, v.items), v.ratings, 5, 20)


@query(f"{VOTES_SQL}, top AS (SELECT * FROM recs WHERE rk<=30) SELECT (SELECT count(*) FROM top) AS n, round(2*coalesce(sum(m.score),0)/(SELECT count(*) FROM top),6) AS similarity FROM top a JOIN top b ON a.user_id=b.user_id AND a.rk<b.rk JOIN cooc m ON m.item_id=a.item_id AND m.similar_id=b.item_id")
def diversification(v: Views) -> DataFrame:
    model = v.settle().model()
    return evaluate.diversification(models.recommend_from_items(v.scored, v.ratings, model, v.restricted), model)


@query(f"{RECS_SQL} SELECT count(*) AS n, round(avg(coalesce(i.rank,0)),6) AS mean_rank FROM recs LEFT JOIN items i USING (item_id) WHERE rk<=40")
def popularity(v: Views) -> DataFrame:
    return evaluate.popularity(v.recs(), v.items)


PICKS_SQL = """picks AS (SELECT user_id, item_id FROM (SELECT s.user_id, s.item_id, row_number() OVER (PARTITION BY s.user_id ORDER BY norm, s.item_id)-1 AS p0, count(*) OVER (PARTITION BY s.user_id) AS n FROM scored s JOIN stats USING (user_id) WHERE norm>=0.6::DOUBLE AND status=2 AND completed>=20)
  WHERE n>10 AND ((p0>=(n+1)//2 AND p0<(n+1)//2+2) OR p0>=n-5))"""


@query(f"{BASE_SQL}, {PICKS_SQL} SELECT user_id, item_id FROM picks")
def middle_and_high(v: Views) -> DataFrame:
    return evaluate.middle_and_high(v.scored)


CASES_SQL = f"""{PICKS_SQL}, cases AS (SELECT user_id, item_id AS out FROM picks), less AS (SELECT c.user_id, c.out, r.item_id, r.status, r.rating FROM cases c JOIN ratings r USING (user_id) WHERE r.item_id<>c.out),
full_lists AS (SELECT c.user_id, c.out, r.item_id, r.status, r.rating FROM cases c JOIN ratings r USING (user_id)),
{stats_sql("less_stats", "less", "user_id,out")}, {scored_sql("less_scored", "less", "less_stats", "user_id,out")}, {votes_sql("user_id,out", "less_scored", "less")}, {tag_sql("user_id,out", full="full_lists")}"""


@query(f"""{MODEL_SQL}, {CASES_SQL}, placed AS (SELECT *, coalesce(sum(CASE WHEN tag IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, out ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS place FROM tagged)
SELECT hits, total, round(hits/total,6) AS recall FROM (SELECT count(*) FILTER (place<=30) AS hits, count(*) AS total FROM cases c LEFT JOIN placed p ON p.user_id=c.user_id AND p.out=c.out AND p.item_id=c.out)""")
def single_item_recall(v: Views) -> DataFrame:
    """Leave-one-out, batched: each (user, held item) is a list of its own, tagged by the user's full list."""
    by, v = ("user_id", "out"), v.settle()
    cases = materialize(evaluate.middle_and_high(v.scored).withColumnRenamed("item_id", "out"), "cases")
    full = materialize(v.ratings.join(cases, "user_id"), "full")
    less = models.without(full, cases.withColumn("item_id", F.col("out")), by)
    recs = models.recommend_from_items(S.scored(less, by=by), less, v.model(), v.restricted, by=by)
    return evaluate.hits(models.tagged(recs, full, v.items, by), cases.withColumn("item_id", F.col("out")), by=by)


CASE_NEAR_SQL = f"""c_nn AS (SELECT user_id, out, sum(q::BIGINT*q)::BIGINT AS n2 FROM less_scored GROUP BY 1,2), u_nn AS (SELECT user_id, sum(q::BIGINT*q)::BIGINT AS n2 FROM scored GROUP BY 1),
c_near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, out ORDER BY score DESC, other_id) AS rk FROM (SELECT d.user_id, d.out, d.other_id, round(dot/sqrt(a.n2::DOUBLE*b.n2),9) AS score FROM (SELECT x.user_id, x.out, y.user_id AS other_id, sum(x.q::BIGINT*y.q)::BIGINT AS dot FROM less_scored x JOIN scored y ON x.item_id=y.item_id AND x.user_id<>y.user_id GROUP BY 1,2,3) d
  JOIN c_nn a ON a.user_id=d.user_id AND a.out=d.out AND a.n2>0 JOIN u_nn b ON b.user_id=d.other_id AND b.n2>0 JOIN less_stats sa ON sa.user_id=d.user_id AND sa.out=d.out JOIN stats sb ON sb.user_id=d.other_id WHERE {SIMILAR_SQL})) WHERE rk<=100),
c_recs AS (SELECT user_id, out, rk, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, out ORDER BY score DESC, item_id)::INT AS rk FROM (SELECT n.user_id, n.out, s.item_id, max(round(CASE WHEN norm>=0 THEN norm*n.score ELSE -0.5::DOUBLE END,9)+0.0::DOUBLE) AS score FROM c_near n JOIN scored s ON s.user_id=n.other_id AND s.status=2
  LEFT JOIN (SELECT user_id, out, item_id FROM less WHERE status<>6) k ON k.user_id=n.user_id AND k.out=n.out AND k.item_id=s.item_id WHERE k.item_id IS NULL AND s.item_id NOT IN (SELECT item_id FROM items WHERE restricted) GROUP BY 1,2,3)) WHERE rk<=100)"""


@query(f"""{MODEL_SQL}, {CASES_SQL}, {CASE_NEAR_SQL}, {tag_sql("user_id,out", "c_recs", "full_lists", "c_tagged")}, placed AS (SELECT *, coalesce(sum(CASE WHEN tag IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, out ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS place, 'cosine' AS method FROM c_tagged
UNION ALL SELECT *, coalesce(sum(CASE WHEN tag IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, out ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS place, 'co-occurrence' FROM tagged)
SELECT method, hits, total, round(hits/total,6) AS recall FROM (SELECT m.method, count(*) FILTER (place<=30) AS hits, count(*) AS total FROM cases c, (VALUES ('cosine'),('co-occurrence')) m(method) LEFT JOIN placed p ON p.user_id=c.user_id AND p.out=c.out AND p.item_id=c.out AND p.method=m.method GROUP BY 1)""")
def recall_by_method(v: Views) -> DataFrame:
    """Single-item recall of two recommenders by one function."""
    found, cases, model = None, evaluate.Cases(v.settle().ratings, evaluate.middle_and_high(v.scored)), v.model()
    methods = {
        "cosine": lambda c: models.recommend_from_users(models.case_cosine(c.scored, c.stats, c.owners.select("user_id", "own"), v.scored, v.stats), v.scored, c.less, v.restricted),
        "co-occurrence": lambda c: models.recommend_from_items(c.scored, c.less, model, v.restricted),
    }
    for name, recommender in methods.items():
        row = evaluate.single_item_recall(recommender, cases, v.items).select(F.lit(name).alias("method"), "hits", "total", "recall")
        found = row if found is None else found.unionByName(row)
    return found


@query(f"{BASE_SQL}, b AS (SELECT user_id, CASE WHEN completed<180 THEN completed//15 ELSE 8+completed//45 END AS bucket FROM stats) SELECT bucket::BIGINT AS bucket, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, round(100.0::DOUBLE*count(DISTINCT item_id)/(SELECT count(*) FROM part),4) AS percent FROM ratings JOIN b USING (user_id) GROUP BY ROLLUP (bucket)")
def sample_coverage(v: Views) -> DataFrame:
    return evaluate.coverage(v.ratings, v.stats, v.items.count()).withColumn("bucket", F.col("bucket").cast("long"))


@query()
def stratified_sample(v: Views) -> DataFrame:
    return evaluate.stratified_sample(v.ratings, v.stats, v.items.count())


def _query_titles(v: Views) -> DataFrame:
    """A search for each item whose id divides by 100: five characters from the third on of its title."""
    return v.items.where("item_id % 100 = 0").select(F.lower(F.substring("title", 3, 5)).alias("query")).distinct()


@query(f"""WITH {ITEMS_SQL}, {TITLES_SQL}, words AS (SELECT item_id, title_id, unnest(list_filter(regexp_split_to_array(lower(title),'[^a-z0-9]+'), lambda x: x<>'')) AS word FROM titles),
suf AS (SELECT item_id, title_id, word, unnest(range(0, greatest(1, CASE WHEN length(word)>10 THEN length(word)//2+2 WHEN length(word)>5 THEN length(word)-3 ELSE length(word)-2 END))) AS start FROM words),
qs AS (SELECT DISTINCT lower(substr(title,3,5)) AS query FROM items WHERE item_id%100=0), qw AS (SELECT query, unnest(list_filter(regexp_split_to_array(query,'[^a-z0-9]+'), lambda x: x<>'')) AS q, generate_subscripts(list_filter(regexp_split_to_array(query,'[^a-z0-9]+'), lambda x: x<>''),1) AS q_at FROM qs),
hit AS (SELECT query, q_at, item_id, title_id, min(CASE WHEN start=0 THEN length(word)-length(q) ELSE start*2-length(q)//3+(length(word)-length(q))*3 END) AS r FROM suf JOIN qw ON starts_with(substr(word,start+1),q) GROUP BY ALL),
tot AS (SELECT query, item_id, title_id, count(*) AS matches, sum(r) AS r FROM hit GROUP BY ALL),
one AS (SELECT *, row_number() OVER (PARTITION BY query, item_id ORDER BY matches DESC, r, title_id DESC) AS k FROM tot)
SELECT query, rk, item_id, title FROM (SELECT query, t.item_id, s.title, row_number() OVER (PARTITION BY query ORDER BY matches DESC, r, rank, t.item_id)::INT AS rk FROM one t JOIN titles s ON s.item_id=t.item_id AND s.title_id=t.title_id JOIN items i ON i.item_id=t.item_id WHERE k=1) WHERE rk<=15""")
def substring_search(v: Views) -> DataFrame:
    return search.substring_suggest(v.titles(), v.items, _query_titles(v))


@query()
def fuzzy_search(v: Views) -> DataFrame:
    return search.fuzzy_suggest(v.titles(), v.items, _query_titles(v))


@query(f"WITH {ITEMS_SQL}, l AS (SELECT CASE WHEN regexp_extract(upper(title),'[A-Z0-9]') BETWEEN 'A' AND 'Z' THEN regexp_extract(upper(title),'[A-Z0-9]') ELSE '0' END AS letter, item_id FROM items) SELECT letter, n, rk, item_id FROM (SELECT letter, count(*) OVER (PARTITION BY letter) AS n, row_number() OVER (PARTITION BY letter ORDER BY (item_id*2654435761)%4294967296, item_id)::INT AS rk, item_id FROM l) WHERE rk<=4")
def browse_by_letter(v: Views) -> DataFrame:
    return search.browse(v.items)


@query("""WITH f AS (SELECT vec_id AS item_id, embedding AS e, label AS g FROM embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id) AS rk FROM (SELECT a.item_id, b.item_id AS similar_id, a.g AS ga, b.g AS gb, round(list_dot_product(a.e::DOUBLE[],b.e::DOUBLE[]),9) AS score FROM f a JOIN f b ON a.item_id<>b.item_id))
SELECT item_id, rk::INT AS rk, similar_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, gb ORDER BY rk) AS seen FROM t WHERE rk<=30 AND ga<>gb) WHERE seen=1""")
def factor_neighbours(v: Views) -> DataFrame:
    e = v.t("embeddings")
    groups = e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("group_id"))
    return factors.item_neighbours(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")), groups)


@query(f"{BASE_SQL} SELECT sa.user_id, sa.completed AS ca, count(*) AS others FROM stats sa JOIN stats sb ON sa.user_id<>sb.user_id WHERE {SIMILAR_SQL} GROUP BY 1,2")
def similar_activity_users(v: Views) -> DataFrame:
    """Counts by number of finished items first, so the pairing is of distinct counts, not of users."""
    counts = v.stats.groupBy("completed").agg(F.count(F.lit(1)).alias("m"))
    fit = similarity.alike(counts.select("completed"), counts.select(F.col("completed").alias("completed_b"), "m")).groupBy(F.col("completed").alias("ca")).agg(F.sum("m").alias("m"))
    # Each user meets the counts near their own; that includes themselves wherever a count is near itself.
    own = F.when(S.similar_activity(F.col("ca"), F.col("ca")), 1).otherwise(0)
    return v.stats.select("user_id", F.col("completed").alias("ca")).join(fit, "ca").select("user_id", "ca", (F.col("m") - own).alias("others")).where("others > 0")


@query(f"{BASE_SQL} SELECT item_id, count(*) AS users, count(*) FILTER (rating>0) AS rated, round(avg(rating) FILTER (rating>0),6) AS mean FROM ratings GROUP BY 1")
def item_frequency(v: Views) -> DataFrame:
    rated = F.when(F.col("rating") > 0, F.col("rating"))
    return v.ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("users"), F.count(rated).alias("rated"), F.round(F.avg(rated), 6).alias("mean"))


@query(f"WITH {ITEMS_SQL} SELECT group_id, count(*) AS n, string_agg(DISTINCT genre, ', ' ORDER BY genre) AS genres, min(rank) AS best FROM items WHERE NOT restricted GROUP BY 1")
def group_summary(v: Views) -> DataFrame:
    return v.items.where("not restricted").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(", ", F.sort_array(F.collect_set("genre"))).alias("genres"), F.min("rank").alias("best"))


@query(f"{BASE_SQL} SELECT user_id, item_id, status FROM ratings r WHERE status=6 AND item_id NOT IN (SELECT item_id FROM items WHERE restricted) AND EXISTS (SELECT 1 FROM stats s WHERE s.user_id=r.user_id AND completed>5 AND completed<500)")
def planned_items(v: Views) -> DataFrame:
    active = v.stats.where("completed > 5 and completed < 500").select("user_id")
    return v.ratings.where("status = 6").join(v.items.where("restricted").select("item_id"), "item_id", "left_anti").join(active, "user_id", "left_semi").select("user_id", "item_id", "status")


@query(f"{QUEUE_SQL} SELECT username, 1+(SELECT count(*) FROM queue b WHERE b.status=0 AND b.insert_time<a.insert_time) AS position FROM queue a WHERE status=0")
def queue_positions(v: Views) -> DataFrame:
    return refresh.positions(v.queue()).withColumn("position", F.col("position").cast("long"))


@query(f"{QUEUE_SQL} SELECT * FROM queue WHERE status=0 OR (status=2 AND status_change<(SELECT max(status_change) FROM queue)-120 AND attempts<3) ORDER BY insert_time, username LIMIT 30")
def queue_due(v: Views) -> DataFrame:
    q = v.queue()
    return refresh.due(q, q.agg(F.max("status_change")).first()[0], 30)


@query(f"{QUEUE_SQL} SELECT * FROM queue WHERE NOT (status=3 OR (status=2 AND attempts>=3))")
def queue_purged(v: Views) -> DataFrame:
    return refresh.purge(v.queue())


@query(f"{QUEUE_SQL} SELECT q.username, insert_time, CASE WHEN ok IS NULL THEN status WHEN ok THEN 3 ELSE 2 END::INT AS status, (attempts+CASE WHEN ok IS NULL THEN 0 ELSE 1 END)::INT AS attempts, coalesce(ts,status_change) AS status_change FROM queue q LEFT JOIN (SELECT 'u'||user_id AS username, bool_and(event_type<>'error') AS ok, max(floor(epoch(ts)))::BIGINT AS ts FROM events WHERE event_id%7=0 GROUP BY 1) o USING (username)")
def queue_settled(v: Views) -> DataFrame:
    out = v.t("events").where("event_id % 7 = 0").select(F.concat(F.lit("u"), "user_id").alias("username"), (F.col("event_type") != "error").alias("ok"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return refresh.settle(v.queue(), out)


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE k=1")
def latest_events(v: Views) -> DataFrame:
    return refresh.latest(v.t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("WITH e AS (SELECT user_id, max(event_id) AS last_change FROM events GROUP BY 1), t AS (SELECT user_id, max(event_id) AS threshold FROM events WHERE event_id%3=0 AND user_id%2=0 GROUP BY 1) SELECT e.user_id, last_change FROM e LEFT JOIN t USING (user_id) WHERE last_change>coalesce(threshold,-1)")
def changed_users(v: Views) -> DataFrame:
    e = v.t("events")
    return refresh.changed_since(e.groupBy("user_id").agg(F.max("event_id").alias("last_change")), e.where("event_id % 3 = 0 and user_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("threshold")), "user_id")


@query("SELECT c_custkey AS user_id, max(epoch(o_orderdate))::BIGINT AS last_update, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY max(epoch(o_orderdate)) DESC, c_custkey DESC)=1 THEN c_nationkey||c_mktsegment ELSE '' END AS username FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment")
def name_owners(v: Views) -> DataFrame:
    users = v.t("customer").join(v.t("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_nationkey", "c_mktsegment").agg(F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("last_update"))
    return refresh.one_owner(users.select(F.col("c_custkey").alias("user_id"), "last_update", F.concat("c_nationkey", "c_mktsegment").alias("username")))


@query("SELECT page_id, nullif(regexp_extract(html,'<title>([^<]*)</title>',1),'') AS title, len(regexp_extract_all(html,'<a href=\"([^\"]*)\"',1))::INT AS links, regexp_extract(html,'<a href=\"([^\"]*)\"',1) AS first_link FROM pages")
def page_fields(v: Views) -> DataFrame:
    link = '<a href="([^"]*)"'
    return v.t("pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit(link), 1)).alias("links"), F.regexp_extract("html", link, 1).alias("first_link"))


@query("SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, strftime(ts,'%Y-%m-%d') AS day FROM events")
def event_fields(v: Views) -> DataFrame:
    return v.t("events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CASE WHEN month(t)<=3 THEN 'Winter' WHEN month(t)<=6 THEN 'Spring' WHEN month(t)<=9 THEN 'Fall' ELSE 'Winter' END||' '||year(t) AS season FROM (SELECT o_orderkey, o_orderdate+INTERVAL 9 HOUR AS t FROM orders)")
def seasons(v: Views) -> DataFrame:
    return v.t("orders").select("o_orderkey", S.season(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("season"))


@query(f"{BASE_SQL} SELECT user_id, '['||string_agg('['||item_id||','||status||','||rating||']', ',' ORDER BY item_id)||']' AS list FROM ratings GROUP BY 1")
def rating_lists(v: Views) -> DataFrame:
    from tastegraph.sources.lists import write_lists

    return write_lists(v.ratings)


@query(f"{BASE_SQL} SELECT user_id, item_id, status, rating FROM ratings")
def rating_lists_round_trip(v: Views) -> DataFrame:
    from tastegraph.sources.lists import read_lists, write_lists

    return read_lists(write_lists(v.ratings)).select("user_id", "item_id", "status", "rating")


from tastegraph.operators import store_queries  # noqa: E402, F401  (registers its queries)
