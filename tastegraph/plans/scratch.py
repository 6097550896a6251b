"""Lineage cuts that survive lost executors.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every
executor shares; only where it is unset (tests, local mode) a temporary one is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[str] = []
_MEMORIES: list[dict] = []


def scratch_root(spark: SparkSession) -> str:
    """URI of the shared folder for intermediate tables."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def forget_on_clear(cache: dict) -> dict:
    """A memory of written tables that is emptied together with them."""
    _MEMORIES.append(cache)
    return cache


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that this process wrote for ``spark``; for the end of a job, when no result refers to them any more."""
    for cache in _MEMORIES:
        cache.clear()
    fs = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _WRITTEN:
        path = fs(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    _WRITTEN.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in folders by the columns ``by``, and read it back; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, sent: Broadcast, name: str) -> DataFrame:
    """``materialize`` of a frame that alone needs the broadcast ``sent``, which is then removed everywhere."""
    table = materialize(df, name)
    sent.destroy()
    return table
