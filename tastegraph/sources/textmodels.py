"""Models as plain text: an optional version line, sizes, then arrays after each other, one number a line.

A file is read as a table of numbered values; its arrays are stretches of the numbers, joined by
their place, so no array is ever held whole. It is written by a sort on (array, place): the part
files in the order of their names are the text. Blank lines do not count, and several values may
share a line. The identifier ``unused`` (0, as the format has it, or another number where 0 is a
real one) stands for a free place and gives no row; a model that holds it is not written. A file whose version is
newer than asked for, or that ends before its arrays do, is an error; one without a version line
has version 1. An array of no values, or an empty sample, gives an empty table. Extra columns of
a table that is written take no part.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegraph.plans.numbering import numbered
from tastegraph.plans.scratch import materialize

_VERSION = re.compile(r"[a-z]+-(\d+)")


def _values(spark: SparkSession, path: str) -> DataFrame:
    """``at, value``: the values of a text file, or of the parts of a folder, numbered from 1."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    words = lines.select("file", "start", "line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "value")).where("value <> ''")
    # A split of a file is the coarse key: its rows are bounded by the size of splits.
    split = [F.col("file"), F.col("start")]
    return materialize(numbered(materialize(words, "text-lines"), split, [*split, F.col("line"), F.col("pos")], "at").select("at", "value"), "text-values")


def _begin(values: DataFrame, sizes: int, newest: int) -> tuple[int, list[str]]:
    """(values before the arrays, the first ``sizes`` values after the version)."""
    head = [r["value"] for r in values.where(F.col("at") <= sizes + 1).orderBy("at").collect()]
    named = _VERSION.fullmatch(head[0]) if head else None
    if named and int(named[1]) > newest:
        raise ValueError(f"version {named[1]} is newer than {newest}")
    skip = 1 if named else 0
    if len(head) < skip + sizes:
        raise ValueError("the file ends before its sizes do")
    return skip + sizes, head[skip : skip + sizes]


def _arrays(values: DataFrame, begin: int, sizes: list[int], kinds: list[str]) -> list[DataFrame]:
    """``place (from 0), value`` of each array."""
    if values.where(F.col("at") > begin).count() < sum(sizes):
        raise ValueError("the file ends before its arrays do")
    out = []
    for size, kind in zip(sizes, kinds):
        inside = values.where((F.col("at") > begin) & (F.col("at") <= begin + size))
        out.append(inside.select((F.col("at") - begin - 1).alias("place"), F.col("value").cast(kind).alias("value")))
        begin += size
    return out


def read_item_model(spark: SparkSession, path: str, newest: int = 1, unused: int = 0) -> DataFrame:
    """``item_id, rk, similar_id, score`` of a neighbour model: neighbours of each, entries, items; then items, neighbours, scores."""
    values = _values(spark, path)
    begin, sizes = _begin(values, 3, newest)
    each, entries, items = map(int, sizes)
    ids, similar, scores = _arrays(values, begin, [items, entries, entries], ["long", "long", "double"])
    rows = similar.where(F.col("value") != unused).select("place", F.col("value").alias("similar_id")).join(scores.withColumnRenamed("value", "score"), "place")
    own = ids.where(F.col("value") != unused).select(F.col("place").alias("_item"), F.col("value").alias("item_id"))
    found = rows.select(F.floor(F.col("place") / max(1, each)).alias("_item"), (F.col("place") % max(1, each) + 1).cast("int").alias("rk"), "similar_id", "score").join(own, "_item")
    return found.select("item_id", "rk", "similar_id", "score")


def _factor_rows(ids: DataFrame, factors: DataFrame, row: Column, column: Column, name: str, unused: int) -> DataFrame:
    """``name, factors`` of numbers that stand at (row, column) of a matrix with a row for each of ``ids``."""
    owner = ids.where(F.col("value") != unused).select(F.col("place").alias("_row"), F.col("value").alias(name))
    cells = factors.select(row.alias("_row"), F.struct(column.alias("c"), F.col("value").alias("x")).alias("cell"))
    rows = cells.groupBy("_row").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return rows.join(owner, "_row").select(name, F.transform("cells", lambda c: c["x"]).alias("factors"))


def read_item_factors(spark: SparkSession, path: str, newest: int = 1, unused: int = 0) -> tuple[float, DataFrame]:
    """(lambda, ``item_id, factors``): lambda, items, rank, rows; then items and the matrix by columns."""
    values = _values(spark, path)
    begin, (penalty, items, rank, rows) = _begin(values, 4, newest)
    ids, cells = _arrays(values, begin, [int(items), int(rank) * int(rows)], ["long", "double"])
    n = max(1, int(rows))
    return float(penalty), _factor_rows(ids, cells, F.col("place") % n, F.floor(F.col("place") / n), "item_id", unused)


def read_user_factors(spark: SparkSession, path: str, newest: int = 1, unused: int = 0) -> DataFrame:
    """``user_id, factors``: rank, numbers, users; then users and the numbers of each user after those of the one before."""
    values = _values(spark, path)
    begin, sizes = _begin(values, 3, newest)
    rank, numbers, users = map(int, sizes)
    ids, cells = _arrays(values, begin, [users, numbers], ["long", "double"])
    n = max(1, rank)
    return _factor_rows(ids, cells, F.floor(F.col("place") / n), F.col("place") % n, "user_id", unused)


def read_sample(spark: SparkSession, path: str, size: int, newest: int = 1) -> DataFrame:
    """``user_id, ord`` of the first ``size`` ids of a sample file."""
    values = _values(spark, path)
    begin, _ = _begin(values, 0, newest)
    return values.where((F.col("at") > begin) & (F.col("at") <= begin + size)).select(F.col("value").cast("long").alias("user_id"), (F.col("at") - begin).alias("ord"))


def _written(head: list, arrays: list[DataFrame], path: str, label: str | None, version: int) -> None:
    """Write ``head`` and the ``place, value`` arrays as the text of a folder, in order."""
    spark = SparkSession.getActiveSession() if not arrays else arrays[0].sparkSession
    first = ([f"{label}-{version}"] if label else []) + [str(x) for x in head]
    parts = [spark.createDataFrame(list(enumerate(first)), "place long, value string").withColumn("part", F.lit(0))] if first else []
    parts += [a.select(F.col("place").cast("long"), F.col("value").cast("string"), F.lit(k).alias("part")) for k, a in enumerate(arrays, 1)]
    ordered = reduce(DataFrame.unionByName, parts).orderBy("part", "place")
    ordered.select("value").write.mode("overwrite").text(path)


def _refuse(ids: DataFrame, unused: int) -> None:
    if not ids.where(F.col(ids.columns[0]) == unused).isEmpty():
        raise ValueError(f"{unused} marks unused places and cannot be an identifier")


def write_item_model(model: DataFrame, path: str, label: str | None = None, version: int = 1, unused: int = 0) -> None:
    """Write ``item_id, rk, similar_id, score``; every item has as many places as the longest list, free ones filled with ``unused``."""
    model = materialize(model.select("item_id", "rk", "similar_id", "score"), "text-model")
    _refuse(model.select("item_id").union(model.select("similar_id")), unused)
    each = model.agg(F.coalesce(F.max("rk"), F.lit(0)).alias("n")).first()["n"]
    ids = materialize(_placed(model.select("item_id").distinct(), "item_id"), "text-items")
    items = ids.count()
    places = ids.select("item_id", "place", F.explode(F.sequence(F.lit(1), F.lit(max(1, each)))).alias("rk"))
    full = places.join(model.select("item_id", F.col("rk").cast("int").alias("rk"), "similar_id", "score"), ["item_id", "rk"], "left")
    full = full.select((F.col("place") * max(1, each) + F.col("rk") - 1).alias("place"), F.coalesce("similar_id", F.lit(unused)).alias("similar_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    arrays = [ids.select("place", F.col("item_id").alias("value")), *(full.select("place", F.col(c).alias("value")) for c in ("similar_id", "score"))]
    _written([each, each * items, items], arrays, path, label, version)


def _placed(ids: DataFrame, name: str) -> DataFrame:
    """``ids`` with ``place`` from 0 in their order."""
    return numbered(ids, [F.shiftright(name, 16)], [F.col(name)], "_at").select(name, (F.col("_at") - 1).alias("place"))


def _cells(factors: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(ids by place, cells ``row, c, value``, ids, rank)."""
    ids = materialize(_placed(factors.select(name).distinct(), name), "text-ids")
    rank = factors.agg(F.coalesce(F.max(F.size("factors")), F.lit(0)).alias("n")).first()["n"]
    cells = factors.select(name, F.posexplode("factors").alias("c", "value")).join(ids, name).select(F.col("place").alias("row"), "c", "value")
    return ids.select("place", F.col(name).alias("value")), cells, ids.count(), rank


def write_item_factors(factors: DataFrame, penalty: float, path: str, label: str | None = None, version: int = 1, unused: int = 0) -> None:
    """Write ``item_id, factors`` (arrays of one length) and their lambda, the matrix by columns."""
    _refuse(factors.select("item_id"), unused)
    ids, cells, n, rank = _cells(factors, "item_id")
    _written([penalty, n, rank, n], [ids, cells.select((F.col("c") * F.lit(n).cast("long") + F.col("row")).alias("place"), "value")], path, label, version)


def write_user_factors(factors: DataFrame, path: str, label: str | None = None, version: int = 1, unused: int = 0) -> None:
    """Write ``user_id, factors`` (arrays of one length), a user's numbers after each other."""
    _refuse(factors.select("user_id"), unused)
    ids, cells, n, rank = _cells(factors, "user_id")
    _written([rank, rank * n, n], [ids, cells.select((F.col("row") * rank + F.col("c")).alias("place"), "value")], path, label, version)


def write_sample(sample: DataFrame, path: str, label: str | None = None, version: int = 1) -> None:
    """Write the ids of ``user_id, ord`` in order, one a line."""
    _written([], [sample.select(F.col("ord").alias("place"), F.col("user_id").alias("value"))], path, label, version)
