"""Places in a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, coarse: list[Column], order: list[Column], name: str = "place", ties: bool = False) -> DataFrame:
    """``df`` with the place, from 1, of each row in ``order``.

    ``coarse`` are ascending keys that ``order`` refines: rows are counted by them, the counts
    (one row for each distinct key) are summed up in order, and places within a key are taken in
    a window of that key alone. With ``ties``, rows equal in ``order`` share the least place.
    """
    keys = [f"_c{k}" for k in range(len(coarse))]
    keyed = df.withColumns(dict(zip(keys, coarse)))
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*[F.col(k).alias(f"{k}b") for k in keys], (F.sum("_n").over(W.orderBy(*keys)) - F.col("_n")).alias("_before"))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}b"))
        same = one if same is None else same & one
    inside = (F.rank() if ties else F.row_number()).over(W.partitionBy(*keys).orderBy(*order))
    return keyed.join(before, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + inside).alias(name))
