"""What registered queries share: frames over the given tables, and the SQL of the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import models
from tastegraph.operators import views as V
from tastegraph.operators.views import ITEMS_SQL, RATINGS_SQL, USERS_SQL
from tastegraph.plans.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SIMILAR_SQL = "CASE WHEN least(sa.completed,sb.completed)=0 THEN false WHEN least(sa.completed,sb.completed)<5 AND greatest(sa.completed,sb.completed)<10 THEN true ELSE greatest(sa.completed,sb.completed)<2*least(sa.completed,sb.completed) END"


def stats_sql(name: str, source: str, by: str = "user_id") -> str:
    return f"""{name} AS (SELECT {by}, n, least, completed, dropped, CASE WHEN n=0 THEN 0.0::DOUBLE ELSE s::DOUBLE/n END AS mean,
  CASE WHEN n*ss-s*s=0 THEN 1.0::DOUBLE ELSE sqrt((n*ss-s*s)::DOUBLE)/n END AS dev FROM (
  SELECT {by}, count(*) FILTER (ok) AS n, coalesce(sum(rating) FILTER (ok),0)::BIGINT AS s, coalesce(sum(rating*rating) FILTER (ok),0)::BIGINT AS ss,
  coalesce(min(rating) FILTER (ok),0)::BIGINT AS least, count(*) FILTER (status=2) AS completed, count(*) FILTER (status=4) AS dropped
  FROM (SELECT *, status IN (2,4) AND rating<>0 AS ok FROM {source}) GROUP BY {by}))"""


def scored_sql(name: str, source: str, stats: str, by: str = "user_id") -> str:
    return f"""{name} AS (SELECT *, greatest(-128, least(127, trunc(norm*32)))::INT AS q FROM (
  SELECT r.*, CASE WHEN rating>0 THEN (rating-mean+0.0::DOUBLE)/dev WHEN status=2 THEN 0.0::DOUBLE/dev ELSE (least+0.0::DOUBLE-mean)/dev END AS norm FROM {source} r JOIN {stats} USING ({by}) WHERE status IN (2,4)))"""


ACTIVE_SQL = "active AS (SELECT user_id FROM stats JOIN users USING (user_id) WHERE completed>5 AND completed<500 AND username<>''), fit AS (SELECT * FROM scored WHERE user_id IN (SELECT user_id FROM active))"
BASE_SQL = f"WITH {RATINGS_SQL}, {stats_sql('stats', 'ratings')}, {scored_sql('scored', 'ratings', 'stats')}, {ITEMS_SQL}, {USERS_SQL}, {ACTIVE_SQL}"
COOC_SQL = """liked AS (SELECT user_id, item_id FROM fit WHERE q>=10), wt AS (SELECT user_id, 1/sqrt(count(*)::DOUBLE) AS w FROM liked GROUP BY 1), often AS (SELECT item_id, count(*) AS f FROM liked GROUP BY 1)"""


def model_sql(name: str, raw: str, k: int) -> str:
    return f"""{name}_raw AS ({raw}), {name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, similar_id) AS rk FROM {name}_raw) WHERE rk<={k}),
{name} AS (SELECT item_id, rk::INT AS rk, similar_id, score FROM (SELECT t.*, row_number() OVER (PARTITION BY t.item_id, b.group_id ORDER BY rk) AS seen FROM {name}_top t
  JOIN items a ON a.item_id=t.item_id JOIN items b ON b.item_id=t.similar_id WHERE a.group_id<>b.group_id) WHERE seen=1)"""


COOC_MODEL_SQL = model_sql("cooc", "SELECT item_id, similar_id, round(raw/(a.f*pow(b.f::DOUBLE,0.7::DOUBLE)),9) AS score FROM (SELECT x.item_id, y.item_id AS similar_id, sum(w) AS raw FROM liked x JOIN liked y USING (user_id) JOIN wt USING (user_id) WHERE x.item_id<>y.item_id GROUP BY 1,2) p JOIN often a USING (item_id) JOIN often b ON b.item_id=similar_id", 30)
AIRING_MODEL_SQL = model_sql("air", "SELECT p.item_id, similar_id, round(CASE WHEN b.f IS NULL THEN raw ELSE raw/(a.f*pow(b.f::DOUBLE,0.7::DOUBLE)) END,9) AS score FROM (SELECT x.item_id, y.item_id AS similar_id, sum(w) AS raw FROM liked x JOIN (SELECT user_id, item_id FROM ratings JOIN items i USING (item_id) WHERE ratings.status=1 AND i.status=1) y USING (user_id) JOIN wt USING (user_id) WHERE x.item_id<>y.item_id GROUP BY 1,2) p JOIN often a ON a.item_id=p.item_id LEFT JOIN often b ON b.item_id=similar_id", 15)
COSINE_SQL = f"""nn AS (SELECT user_id, sum(q::BIGINT*q)::BIGINT AS n2 FROM scored GROUP BY 1), near AS (SELECT user_id, rk, other_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, other_id)::INT AS rk FROM (
  SELECT d.user_id, d.other_id, round(dot/sqrt(a.n2::DOUBLE*b.n2),9) AS score FROM (SELECT x.user_id, y.user_id AS other_id, sum(x.q::BIGINT*y.q)::BIGINT AS dot FROM scored x JOIN scored y ON x.item_id=y.item_id AND x.user_id<>y.user_id GROUP BY 1,2) d
  JOIN nn a ON a.user_id=d.user_id AND a.n2>0 JOIN nn b ON b.user_id=d.other_id AND b.n2>0 JOIN stats sa ON sa.user_id=d.user_id JOIN stats sb ON sb.user_id=d.other_id WHERE {SIMILAR_SQL})) WHERE rk<=100)"""
RECOMMEND_SQL = """recs AS (SELECT user_id, rk, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INT AS rk FROM (
  SELECT n.user_id, s.item_id, max(round(CASE WHEN norm>=0 THEN norm*n.score ELSE -0.5::DOUBLE END,9)+0.0::DOUBLE) AS score FROM near n JOIN scored s ON s.user_id=n.other_id AND s.status=2
  LEFT JOIN (SELECT user_id, item_id FROM ratings WHERE status<>6) k ON k.user_id=n.user_id AND k.item_id=s.item_id
  WHERE k.item_id IS NULL AND s.item_id NOT IN (SELECT item_id FROM items WHERE restricted) GROUP BY 1,2)) WHERE rk<=100)"""


def tag_sql(by: str = "user_id", recs: str = "recs", full: str = "ratings", name: str = "tagged") -> str:
    on = " AND ".join(f"p.{c}=r.{c}" for c in by.split(","))
    return f"""{name}_g AS (SELECT {by}, group_id, bool_or(p.status<>6) AS kg, bool_or(p.status=6) AS pg FROM {full} p JOIN items USING (item_id) GROUP BY ALL),
{name} AS (SELECT {by}, rk, item_id, score, CASE WHEN pl AND kg THEN 'planned-and-group' WHEN pl THEN 'planned' WHEN kg THEN 'group' WHEN pg THEN 'planned-group' WHEN again>1 THEN 'same-group' END AS tag FROM (
  SELECT r.*, coalesce(f.status=6,false) AS pl, coalesce(p.kg,false) AS kg, coalesce(p.pg,false) AS pg, row_number() OVER (PARTITION BY {", ".join("r." + c for c in by.split(","))}, i.group_id ORDER BY r.rk) AS again
  FROM {recs} r JOIN items i USING (item_id) LEFT JOIN {name}_g p ON {on} AND p.group_id=i.group_id LEFT JOIN {full} f ON {on.replace("p.", "f.")} AND f.item_id=r.item_id))"""


def votes_sql(by: str = "user_id", source: str = "scored", known: str = "ratings", name: str = "recs", model: str = "cooc") -> str:
    on = " AND ".join(f"k.{c}=v.{c}" for c in by.split(","))
    cols = ", ".join("b." + c for c in by.split(","))
    return f"""{name}_best AS (SELECT * FROM (SELECT {by}, item_id, q, row_number() OVER (PARTITION BY {by} ORDER BY q DESC, item_id) AS place FROM {source}) WHERE place<=20),
{name} AS (SELECT {by}, rk, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, item_id)::INT AS rk FROM (SELECT v.* FROM (SELECT {cols}, m.similar_id AS item_id, (sum(round(m.score*1e9)::BIGINT*q)::BIGINT)::DOUBLE/32e9::DOUBLE AS score FROM {name}_best b JOIN {model} m USING (item_id) GROUP BY ALL) v
  LEFT JOIN (SELECT {by}, item_id FROM {known} WHERE status<>6) k ON {on} AND k.item_id=v.item_id WHERE k.item_id IS NULL AND v.item_id NOT IN (SELECT item_id FROM items WHERE restricted))) WHERE rk<=100)"""


TAG_SQL = tag_sql()
NEAR_SQL = f"{BASE_SQL}, {COSINE_SQL}"
RECS_SQL = f"{NEAR_SQL}, {RECOMMEND_SQL}"
MODEL_SQL = f"{BASE_SQL}, {COOC_SQL}, {COOC_MODEL_SQL}"
VOTES_SQL = f"{MODEL_SQL}, {votes_sql()}"
QUEUE_SQL = """WITH queue AS (SELECT username, insert_time, (e%4)::INT AS status, (e%5)::INT AS attempts, status_change FROM (SELECT 'u'||user_id AS username, min(floor(epoch(ts)))::BIGINT AS insert_time, count(*) FILTER (event_type='error') AS e, max(floor(epoch(ts)))::BIGINT AS status_change FROM events GROUP BY 1))"""


class Views:
    """Lazily built frames that the queries share."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.ratings, self.items, self.users = V.ratings(spark, d), V.items(spark, d), V.users(spark, d)
        self._settled = False
        self._derive()

    def _derive(self) -> None:
        self.stats = S.user_stats(self.ratings)
        self.scored = S.scored(self.ratings)
        self.restricted = self.items.where("restricted")
        self.shown = V.catalogue(self.items)

    def t(self, name: str) -> DataFrame:
        return V.table(self.spark, self.d, name)

    def settle(self) -> Views:
        """Write what a query reads many times; the tables are then read once, and models are kept too."""
        if not self._settled:
            self.ratings, self.items = materialize(self.ratings, "ratings"), materialize(self.items, "items")
            self._derive()
            self.stats, self.scored, self._settled = materialize(self.stats, "stats"), materialize(self.scored, "scored"), True
        return self

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self._settled else df

    def fit(self) -> DataFrame:
        """Ratings of the users that models are built on."""
        return self._kept(self.scored.join(models.active(self.stats, self.users), "user_id", "left_semi"), "fit")

    def near(self) -> DataFrame:
        self.settle()
        return models.user_cosine(self.scored, self.stats)

    def model(self) -> DataFrame:
        self.settle()
        return self._kept(models.co_occurrence(self.fit(), self.items), "model")

    def model_in_progress(self) -> DataFrame:
        now = self.items.where(F.col("status") == V.IN_PROGRESS).select("item_id")
        watching = self.ratings.where(F.col("status") == V.WATCHING).join(now, "item_id", "left_semi")
        return models.co_occurrence(self.fit(), self.items, watching.select("user_id", "item_id"), k=15)

    def recs(self) -> DataFrame:
        near = self.settle().near()
        return models.recommend_from_users(near, self.scored, self.ratings, self.restricted)

    def votes(self) -> DataFrame:
        model = self.settle().model()
        return models.recommend_from_items(self.scored, self.ratings, model, self.restricted)

    def titles(self) -> DataFrame:
        return V.titles(self.shown, V.alternate_titles(self.spark, self.d))

    def queue(self) -> DataFrame:
        e = self.t("events").select(F.concat(F.lit("u"), "user_id").alias("username"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "event_type")
        first = e.groupBy("username").agg(F.min("ts").alias("insert_time"), F.count_if(F.col("event_type") == "error").cast("int").alias("attempts"), F.max("ts").alias("status_change"))
        return first.select("username", "insert_time", (F.pmod(F.col("attempts"), F.lit(4))).cast("int").alias("status"), F.pmod(F.col("attempts"), F.lit(5)).alias("attempts"), "status_change")


def query(sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(Views(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
