"""SimHash near-duplicate detection.

Fingerprints are 64-bit majorities over the XXH64 values (seed 42) of three-word
shingles. Two fingerprints that differ in at most three bits agree on at least two of
five bit blocks, so each distinct fingerprint is posted under the ten pairs of blocks
and only fingerprints that meet under a key are compared. A key with many fingerprints
is cut into chunks that are compared chunk against chunk, each in bounded memory, and
each comparison hands on a spanning forest of its links, never all pairs.

Nulls, blanks: a null text counts as empty; without words the fingerprint is zero,
linked like any other. Repeated rows and ties share a component. An empty table gives
an empty result. A group whose rows all lack a doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import map_rows
from tastegraph.plans.components import connected_components
from tastegraph.plans.scratch import materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
#: (first bit, width) of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A key with more fingerprints than this is compared chunk by chunk.
CHUNK = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each word shingle of the whole text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), 42)]
    return [digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(width)))]


def fingerprints(texts: list[str | None], width: int = SHINGLE_WORDS, block: int = 512) -> np.ndarray:
    """Unsigned 64-bit fingerprints; bits counted by byte histograms, ``block`` documents at a time."""
    out = np.zeros(len(texts), np.uint64)
    for at in range(0, len(texts), block):
        lists = [shingle_hashes(t, width) for t in texts[at : at + block]]
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(lists)) * 256, sizes)
        octets = flat.view(np.uint8).reshape(-1, 8)
        value = np.zeros(len(lists), np.uint64)
        for byte in range(8):
            counts = np.bincount(owner + octets[:, byte], minlength=len(lists) * 256).reshape(-1, 256) @ _BITS
            for bit in range(8):
                value |= (2 * counts[:, bit] > sizes).astype(np.uint64) << np.uint64(8 * byte + bit)
        out[at : at + block] = value
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, fp)``; fp holds the fingerprint's bits as a signed long, key tells rows of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [x if isinstance(x, str) else None for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "fp": fingerprints(texts).view(np.int64)})

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return map_rows(source, run, "fp long", ids=("doc_id", "key"))


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever is within MAX_BITS, found breadth first."""
    left, found = values, []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= MAX_BITS
            if near.any():
                for x in left[near]:
                    found.append((int(at), int(x)))
                    queue.append(x)
                left = left[~near]
    return found


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (bucket, i, j); each run of equal keys is linked on its own."""
    rest: pd.DataFrame | None = None

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        key = pdf[["bucket", "i", "j"]].to_numpy(np.int64)
        cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        start = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((start, [len(fp)])))
        run = np.repeat(np.arange(len(start)), size)
        a, b = [], []
        small = size[run] <= 8
        for gap in range(1, 8):
            if len(fp) > gap:
                hit = np.flatnonzero((run[gap:] == run[:-gap]) & small[gap:] & (np.bitwise_count(fp[gap:] ^ fp[:-gap]) <= MAX_BITS))
                a.append(fp[hit])
                b.append(fp[hit + gap])
        for k in np.flatnonzero(size > 8):
            pairs = np.array(_forest(fp[start[k] : start[k] + size[k]]), np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        ends = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = pdf[["bucket", "i", "j"]].iloc[-1]
        tail = (pdf["bucket"] == last["bucket"]) & (pdf["i"] == last["i"]) & (pdf["j"] == last["j"])
        rest = pdf[tail]
        if not tail.all():
            yield linked(pdf[~tail])
    if rest is not None and len(rest):
        yield linked(rest)


def fingerprint_links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` links that connect all distinct fingerprints at MAX_BITS or fewer."""
    distinct = materialize(fps.select("fp").where("fp is not null").distinct(), "fingerprints")
    part = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND((1 << BLOCKS[k][1]) - 1)
    keys = [
        F.lit(n * 2**26) + F.shiftleft(part(x), 13) + part(y) for n, (x, y) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    shared = posted.groupBy("bucket").count().where("count > 1")
    held = posted.join(shared, "bucket").withColumn("n", F.ceil(F.col("count") / chunk))
    mine = F.pmod(F.xxhash64("fp"), F.col("n"))
    rows = held.select(
        "bucket", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    ).select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    ready = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    return ready.mapInPandas(_links, "a long, b long").distinct()


def with_components(reps: DataFrame, fps: DataFrame) -> DataFrame:
    """``reps``, a row for each distinct fp of ``fps``, with its ``component``."""
    comps = materialize(connected_components(fingerprint_links(fps)), "simhash-components")
    return reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    fps = materialize(with_fingerprints(docs, id_col, text_col), "simhash")
    placed = with_components(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), fps)
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "component").select(F.col("fp"), "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the least doc_id.

    Rows of one doc_id, or of none, are told apart by their text: each group keeps one row of
    its own. A row without a doc_id stays only where its whole group has none.
    """
    names = docs.columns
    fps = materialize(with_fingerprints(docs, id_col, text_col), "simhash")
    equal = fps.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    reps = equal.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "times")).alias("rep"))
    least = with_components(reps, fps).groupBy("component").agg(F.min("rep").alias("rep"))
    keep = materialize(least.select("rep.doc_id", "rep.key", "rep.times"), "simhash-found")
    packed = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_key"))
    kept = packed.join(keep, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    again = kept.where("times > 1").dropDuplicates(["_id", "_key"])
    return kept.where("times = 1").select("row.*").unionByName(again.select("row.*"))
