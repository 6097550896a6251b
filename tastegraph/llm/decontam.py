"""Benchmark decontamination: three-word seeds, then Smith-Waterman alignment.

The benchmark is cut into slices of bounded size, each broadcast. One pass over the whole
texts finds every place where a document holds a three-word gram of an item, with as many
words around it as an alignment at the threshold can span. A place is left out only if it
holds too few of the item's words for the threshold, whatever their order; all others are
aligned, word by word, with their item, many at once: a row of the alignment is a few numpy
operations over a batch. No gram is too frequent to be a seed, so what one document holds
never depends on the others. The score is the best local alignment over that of an exact
copy. A copy so edited that no three words in a row are left has no seed.

Words are lower-cased runs of letters and digits. Nulls, blanks: null texts count as empty
and match nothing; items of fewer than three words have no gram and match nothing. Items
that repeat are each reported; rows of one doc_id are reported once, with their best score,
but dropped each by its own text.
An empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import map_rows
from tastegraph.plans.scratch import materialize, written

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Characters of benchmark text that are broadcast at once.
SLICE_CHARS = 8_000_000
#: Words of passages that are collected for alignment at once, about.
BATCH_WORDS = 500_000
#: Pairs of a place and an item that are held at once, about.
EXPANDED = 1_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class ItemGrams:
    """Lookup tables of a slice of items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.items = [(i, words_of(t)) for i, t in items]
        vocab: dict[str, int] = {}
        for _, ws in self.items:
            for w in ws:
                vocab.setdefault(w, len(vocab) + 1)
        self.vocab, self.base = vocab, len(vocab) + 1
        rows, self.bags = set(), []
        for k, (_, ws) in enumerate(self.items):
            own = [vocab[w] for w in ws]
            self.bags.append(np.unique(np.array(own, np.int64), return_counts=True))
            rows.update(((a * self.base + b) * self.base + c, k) for a, b, c in zip(own, own[1:], own[2:]))
        order = sorted(rows)
        self.key, self.item = np.array([r[0] for r in order], np.int64), np.array([r[1] for r in order], np.int64)
        self.length = np.array([len(ws) for _, ws in self.items], np.int64)
        # A score of the threshold needs so many equal words, and spans so many words of a text at most.
        self.need = threshold * self.length - 1e-9
        self.reach = np.ceil(self.length * (1 + 2 * max(0.0, 1 - threshold))).astype(np.int64)

    def can_reach(self, k: int, ids: np.ndarray) -> bool:
        """Whether the words hold enough of the item's for the threshold, in any order."""
        own, most = self.bags[k]
        at = np.searchsorted(own, ids)
        at[at == len(own)] = 0
        found = np.bincount(at[own[at] == ids], minlength=len(own))
        return np.minimum(found, most).sum() >= self.need[k]

    def passages(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(item number, words) of each place in the whole text that may hold the item."""
        words = words_of(text)
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if len(ids) < GRAM or not len(self.key):
            return
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        if not len(at):
            return
        key = (a[at] * self.base + b[at]) * self.base + c[at]
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return
        count = hi - lo
        # Grams of many items are looked at in runs of places, so that no more than EXPANDED pairs are held.
        run = np.cumsum(count) // EXPANDED
        for begin, until in zip(np.searchsorted(run, np.unique(run), "left"), np.searchsorted(run, np.unique(run), "right")):
            yield from self._places(words, ids, at[begin:until], lo[begin:until], count[begin:until])

    def _places(self, words: list[str], ids: np.ndarray, at: np.ndarray, lo: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        row = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pos, item = np.repeat(at, count), self.item[row]
        order = np.lexsort((pos, item))
        pos, item = pos[order], item[order]
        cut = np.flatnonzero((item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > self.reach[item[1:]])) + 1
        for s, e in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)]))):
            k, n = int(item[s]), int(self.reach[item[s]])
            first, last = max(0, int(pos[s]) - n), min(len(words), int(pos[e - 1]) + GRAM + n)
            # A long place is cut into overlapping stretches; an alignment of the item fits into one.
            for f in range(first, max(first + 1, last - n), 2 * n):
                t = min(last, f + 3 * n)
                if ((pos[s:e] >= f) & (pos[s:e] < t)).any() and self.can_reach(k, ids[f:t]):
                    yield k, words[f:t]


def align(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Best local alignment score of each (item words, passage words), as a share of the item's own."""
    if not pairs:
        return np.zeros(0)
    ids: dict[str, int] = {}
    number = lambda ws: [ids.setdefault(w, len(ids) + 1) for w in ws]
    a, b = [number(x) for x, _ in pairs], [number(y) for _, y in pairs]
    la, lb = max(map(len, a)), max(map(len, b))
    x, y = np.full((len(pairs), la), -1, np.int32), np.full((len(pairs), lb), -2, np.int32)
    for k in range(len(pairs)):
        x[k, : len(a[k])], y[k, : len(b[k])] = a[k], b[k]
    above, best = np.zeros((len(pairs), lb + 1), np.int32), np.zeros(len(pairs), np.int32)
    slope = -GAP * np.arange(lb + 1, dtype=np.int32)
    for i in range(la):
        row = np.zeros_like(above)
        diagonal = above[:, :-1] + np.where(y == x[:, i : i + 1], MATCH, MISMATCH)
        row[:, 1:] = np.maximum(np.maximum(diagonal, above[:, 1:] + GAP), 0)
        # A gap along the row: the best value to the left less its distance.
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        above = row
        best = np.maximum(best, row.max(axis=1))
    return best / np.maximum(1, MATCH * np.array([len(p) for p in a]))


def _matches_of_slice(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(ItemGrams(items, threshold))

    def scored(rows: list[tuple[str | None, str, int, list[str]]]) -> pd.DataFrame:
        grams = sent.value
        order = sorted(range(len(rows)), key=lambda r: len(rows[r][3]) * grams.length[rows[r][2]])
        result = np.zeros(len(rows))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            result[part] = align([(grams.items[rows[r][2]][1], rows[r][3]) for r in part])
        out = pd.DataFrame({"doc_id": [r[0] for r in rows], "key": [r[1] for r in rows], "item_id": [grams.items[r[2]][0] for r in rows], "score": result})
        return out[out["score"] >= threshold]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for d, key, t in zip(pdf["doc_id"], pdf["key"], pdf["text"]):
                for k, ws in sent.value.passages(t):
                    rows.append((d, key, k, ws))
                    size += len(ws)
                    if size >= BATCH_WORDS:
                        yield scored(rows)
                        rows, size = [], 0
        if rows:
            yield scored(rows)

    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(texts, find, "item_id long, score double", ids=("doc_id", "key")), sent


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``(doc_id, key, item_id, score)`` of places that hold an item; key tells rows of one doc_id apart."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_chars))
    found = None
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).orderBy("item_id", "text")
        one, sent = _matches_of_slice(docs, [(r["item_id"], r["text"]) for r in part.collect()], threshold)
        if slices > 1:  # written one after another, so that one slice of the items is held at a time
            one = written(one, sent, "slice-matches")
        found = one if found is None else found.unionByName(one)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``(doc_id, item_id, score)`` of each document that holds an item or an edited copy of it."""
    return matches(docs, benchmark, threshold, slice_chars).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold benchmark material; same columns."""
    bad = materialize(matches(docs, benchmark, threshold).select(F.col("doc_id").alias("_bad"), F.col("key").alias("_bad_key")).distinct(), "contaminated")
    own = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(bad, (own == bad["_bad_key"]) & docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
