"""Tables that change in place: upserts by key bucket, side tables with their item, and sync of two stores.

A table is Parquet dealt by a hash of its key into ``_bucket`` partitions. A batch rewrites the
buckets that it changes and no others, each once: what will stand there is first staged whole
beside the table, then published by dynamic partition overwrite. A run that dies in between is
made good by ``recover``, with which streams and syncs begin; a batch that changes nothing
writes nothing, so a replay leaves every file as it was. A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastegraph.operators.attach import key_page, page_end
from tastegraph.plans.scratch import materialize
from tastegraph.streaming.changes import changed_rows
from tastegraph.streaming.refresh import changed_since, latest


class BucketedTable:
    """Rows by ``key`` under ``path``; a key may have many (side tables) or one."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.select(*self.columns).withColumn("_bucket", self.bucket()).repartition(self.buckets, "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    def create(self, rows: DataFrame) -> BucketedTable:
        self._delete(self.path)
        self._write(rows, self.path)
        return self

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; no others are read."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(self.path)
        if buckets is not None:
            found = found.where(F.col("_bucket").isin(buckets)) if buckets else found.limit(0)
        return found.select(*self.columns)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys``; there are at most as many as the table has."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def replace(self, keys: DataFrame, rows: DataFrame, batch: str) -> list[int]:
        """Put ``rows`` in place of all rows of ``keys``; gives the buckets that were written."""
        own = self.touched(keys)
        if not own:
            return []
        staged = f"{self.path}/_staged-{batch}"
        left = self.rows(own).join(keys.select(self.key).distinct(), self.key, "left_anti").select(*self.columns)
        self._delete(staged)
        self._write(left.unionByName(rows.select(*self.columns)), staged)
        self.spark.createDataFrame([(b,) for b in own], "b int").coalesce(1).write.mode("overwrite").json(f"{staged}/_touched")
        return self._publish(staged)

    def _publish(self, staged: str) -> list[int]:
        own = sorted(r["b"] for r in self.spark.read.schema("b int").json(f"{staged}/_touched").collect())
        new = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(staged)
        full = {r[0] for r in new.select("_bucket").distinct().collect()}
        self._write(new, self.path)
        for b in own:
            if b not in full:  # an overwrite does not empty a bucket
                self._delete(f"{self.path}/_bucket={b}")
        self._delete(staged)
        return own

    def recover(self) -> list[str]:
        """Publish what a died run had staged whole, and drop what it had not; gives the names of both."""
        fs, at = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        names = sorted(n for n in names if n.startswith("_staged-"))
        for n in names:
            if self._exists(f"{self.path}/{n}/_touched/_SUCCESS"):
                self._publish(f"{self.path}/{n}")
            else:
                self._delete(f"{self.path}/{n}")
        return names


def upsert(table: BucketedTable, changes: DataFrame, order: list[str], batch: str, sides: dict[str, BucketedTable] | None = None, newer: str | None = None) -> dict[str, list[int]]:
    """Buckets rewritten by the last change of each key, by table.

    ``sides`` maps array columns of ``changes`` to side tables whose rows of a changed item are
    replaced by the array's structs (a null array leaves them alone). With ``newer``, a change that is not later in that column
    than the stored row changes nothing. Rows with a null key are passed over.
    """
    last = materialize(latest(changes.where(F.col(table.key).isNotNull()), [table.key], order), "changes")
    old = table.rows(table.touched(last))
    if newer:
        stored = old.select(table.key, F.col(newer).alias("threshold"))
        last = materialize(changed_since(last, stored, table.key, newer), "newer")
    new = materialize(changed_rows(last.select(*table.columns), old, table.key), "changed")
    written = {"": table.replace(new, new, batch)}
    for column, side in (sides or {}).items():
        given = last.where(F.col(column).isNotNull())
        rows = materialize(given.select(table.key, F.inline(column)).select(*side.columns), "side")
        stands = side.rows(side.touched(given)).join(given.select(table.key), table.key, "left_semi").select(*side.columns)
        # Items whose side rows differ in any way, counted by whole rows.
        both = stands.withColumn("_n", F.lit(-1)).unionByName(rows.withColumn("_n", F.lit(1)))
        differ = materialize(both.groupBy(*side.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(table.key).distinct(), "differ")
        written[column] = side.replace(differ, rows.join(differ, table.key, "left_semi"), batch)
    return written


def upsert_stream(changes: DataFrame, table: BucketedTable, order: list[str], checkpoint: str, sides: dict[str, BucketedTable] | None = None, newer: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A stream of changes applied batch by batch; by default all that has come, then it ends."""

    for t in [table, *(sides or {}).values()]:
        t.recover()

    def apply(rows: DataFrame, number: int) -> None:
        upsert(table, rows, order, str(number), sides, newer)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Marks:
    """What a sync has seen: the key up to which its pass has come, and the latest change of the last whole pass."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def get(self) -> tuple[int | None, int | None]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None, None
        row = self.spark.read.schema("key long, time long").json(self.path).first()
        return row["key"], row["time"]

    def put(self, key: int | None, time: int | None) -> None:
        self.spark.createDataFrame([(key, time)], "key long, time long").coalesce(1).write.mode("overwrite").json(self.path)


def sync(source: BucketedTable, target: BucketedTable, time: str, marks: Marks | None = None, page: int = 100_000, on_page: Callable[[int], None] | None = None) -> dict[str, int]:
    """Send ``target`` what ``source`` has newer, or alone; ``pages`` and ``sent`` of the pass.

    The target's keys are gone through in pages, each with what the target has of it, until a page
    ends at -1; what the source has in a page's range and the target lacks counts as never
    seen, and the last range is open. With ``marks``, a pass that died goes on behind its last page, and a
    later pass looks only at what changed in the source since the last whole one.
    """
    target.recover()
    at, since = marks.get() if marks else (None, None)
    top = source.rows().agg(F.max(time)).first()[0]
    pages = sent = 0
    while True:
        ids = target.rows().select(target.key, F.col(time).alias("threshold"))
        there = materialize(key_page(ids, target.key, -(2**63) if at is None else at, page), "page")
        end = page_end(there, target.key).first()[0]
        range_rows = source.rows() if at is None else source.rows().where(F.col(source.key) > at)
        if end != -1:
            range_rows = range_rows.where(F.col(source.key) <= end)
        if since is not None:
            range_rows = range_rows.where(F.col(time) > since)
        news = materialize(changed_since(range_rows, there, target.key, time), "news")
        n = news.count()
        if n:
            upsert(target, news, [time], f"sync-{pages}")
        pages, sent = pages + 1, sent + n
        if end == -1:
            break
        at = end
        if marks:
            marks.put(at, since)
        if on_page:
            on_page(end)
    if marks:
        marks.put(None, top)
    return {"pages": pages, "sent": sent}
