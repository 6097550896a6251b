"""Stored models: Parquet with a version beside it, staged and then published together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The newest layout that this library reads; a model without a version has layout 1.
VERSION = 2


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_model(model: DataFrame, folder: str, name: str, version: int = VERSION) -> None:
    """Stage a model under ``folder``; readers see it after ``publish``."""
    model.write.mode("overwrite").parquet(f"{folder}/{name}.new/rows")
    model.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.new/version")


def publish(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Put all staged models in the place of the published ones, or none if one is not staged."""
    fs, _ = _fs(spark, folder)
    of = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    missing = [n for n in names if not fs.exists(of(f"{n}.new"))]
    if missing:
        raise FileNotFoundError(f"not staged: {', '.join(missing)}")
    for n in names:
        if fs.exists(of(n)):
            fs.rename(of(n), of(f"{n}.old-{uuid.uuid4().hex}"))
        if not fs.rename(of(f"{n}.new"), of(n)):
            raise OSError(f"could not publish {n}")


def read_model(spark: SparkSession, folder: str, name: str, newest: int = VERSION) -> DataFrame:
    """A published model; one of a newer layout is an error."""
    fs, _ = _fs(spark, folder)
    path = f"{folder}/{name}"
    version = 1
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version")):
        version = spark.read.parquet(f"{path}/version").agg(F.max("version")).first()[0]
    if version > newest:
        raise ValueError(f"model {name} has layout {version}, newer than {newest}")
    return spark.read.parquet(f"{path}/rows")
