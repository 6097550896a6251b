"""Bounded labelled samples for the classifiers that are trained here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(source: DataFrame, run: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``source.mapInPandas`` with the id columns carried as text, so that a null among them does not turn them into floats."""
    kinds = {c: source.schema[c].dataType for c in ids}
    head = ", ".join(f"`{c}` string" for c in ids)
    out = source.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(run, f"{head}, {schema}")
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``n``; null stays null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def spread(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``key``; equal inputs give equal rows."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(7)), key).limit(n)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` rows, at most some thousands with a ``doc_id`` each, with the least of the texts that stand under it; one row for an id."""
    found = docs.select(F.col("doc_id").alias("_of"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("_of") == F.col("doc_id"))
    others = [c for c in chosen.columns if c != "doc_id"]
    return found.groupBy("doc_id", *others).agg(F.min("text").alias("text"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, n: int, only: int | None = None) -> DataFrame:
    """``(doc_id, label, text)`` for at most ``n`` labelled doc_ids that ``allowed`` admits, of the label ``only`` if one is given.

    A doc_id with contradictory labels, or a null one, is not used; one that stands in several
    rows counts once. The chosen ids, at most ``n`` rows of two numbers, are broadcast; texts stay
    where they are.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
    agreed = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most")
    agreed = agreed if only is None else agreed.where(F.col("label") == only)
    return texts_of(docs, spread(agreed.select("doc_id", "label"), n)).select("doc_id", "label", "text")
