"""Toxicity by FTRL-proximal logistic regression.

Features are the presence of hashed words and word stems (one-word grams), word pairs and
pairs with one word skipped, in 2^20 slots. Per-coordinate learning rates and the L1 term (McMahan et al., KDD 2013)
leave few non-zero weights, which are broadcast as a compact pair of arrays.

Nulls, blanks: a null text counts as empty; a text without words scores the bias alone.
Repeated rows are scored each. Without labels every score is 0.5. An empty table gives an
empty result. Extra columns of the inputs are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import crc_mod, labelled_texts, map_rows

BITS = 20
#: Bound of the training sample.
SAMPLE = 8000
ALPHA, BETA, L2, EPOCHS = 1.0, 1.0, 1.0, 4
#: The L1 term is a hundredth of the number of toxic examples, within these bounds.
L1 = (1.0, 6.0)
#: Words that a worker remembers, some 60 MB.
MEMO = 250_000
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Row of each word in a table of crc32 values: the word, its four- and its five-letter stem."""

    def __init__(self) -> None:
        self.table = np.zeros((MEMO + 1, 3), np.uint32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        self.table[k] = [zlib.crc32(x.encode("utf-8", "replace")) for x in (word, word[:4] + "-", word[:5] + "--")]
        self[word] = k
        return k


_HASHES = _Hashes()


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, slot) of every word, stem, pair and skip-pair of the whole texts, repeats included."""
    lists = [_WORD.findall(t.lower()) for t in texts]
    size = np.array([len(x) for x in lists], np.int64)
    parts = []
    for words in lists:
        if len(_HASHES) + len(words) > MEMO:
            _HASHES.clear()
        for at in range(0, len(words), MEMO):
            if at:
                _HASHES.clear()
            rows = np.fromiter(map(_HASHES.__getitem__, words[at : at + MEMO]), np.int64)
            parts.append(_HASHES.table[rows])
    h = (np.concatenate(parts) if parts else np.zeros((0, 3), np.uint32)).astype(np.uint64)
    doc = np.repeat(np.arange(len(lists)), size)
    shift, mul = np.uint64(64 - BITS), np.uint64(0x9E3779B97F4A7C15)
    docs, out = [doc] * 3, [(h[:, k] * mul) >> shift for k in range(3)]
    for gap, salt in ((1, 0x85EBCA6B), (2, 0xC2B2AE35)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            mixed = ((h[:-gap, 0] * np.uint64(salt)) ^ (h[gap:, 0] + np.uint64(gap))) * mul
            docs.append(doc[gap:][same])
            out.append((mixed >> shift)[same])
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero; slot 2^BITS holds the bias, which bears no L1."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    one = np.full(2**BITS + 1, np.clip(sum(y for _, y in rows) / 100, *L1))
    one[-1] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= one[i], 0.0, -(z[i] - np.sign(z[i]) * one[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, label in rows:
            i = np.append(idx, 2**BITS)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(2**BITS + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed=None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most ``sample`` labelled documents, in one task; returns the sparse weights."""
    texts = labelled_texts(docs, labels, "toxic", F.lit(True) if allowed is None else allowed, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, slot = slots(pdf["text"].tolist())
            pairs = np.unique(doc * 2**BITS + slot)
            parts = np.split(pairs % 2**BITS, np.searchsorted(pairs // 2**BITS, np.arange(1, len(pdf))))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "idx": parts})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(((zlib.crc32(str(d).encode()), int(y), tuple(np.asarray(i)[:3]), np.asarray(i)) for b in batches for d, y, i in zip(b["doc_id"], b["label"], b["idx"])), key=lambda r: r[:3])
        if rows:
            at, w = train([(i, y) for _, y, _, i in rows])
            yield pd.DataFrame({"slot": at, "weight": w})

    found = texts.mapInPandas(measure, f"doc_id {kind}, label int, idx array<int>").repartition(1).mapInPandas(learn, "slot int, weight double").toPandas()
    return found["slot"].to_numpy(np.int64), found["weight"].to_numpy(float)


def score_texts(texts: list[str], weights: np.ndarray, block: int = 512) -> np.ndarray:
    """Probability that each whole text is toxic; ``weights`` is dense, bias last."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), block):
        part = texts[at : at + block]
        doc, slot = slots(part)
        hit = weights[slot] != 0
        pairs = np.unique(doc[hit] * 2**BITS + slot[hit])
        out[at : at + block] = weights[-1] + np.bincount(pairs // 2**BITS, weights[pairs % 2**BITS], len(part))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` for every row."""
    at, w = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense = np.zeros(2**BITS + 1)
        dense[at] = w
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score_texts(pdf["text"].tolist(), dense)})

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; rows with crc32(doc_id) mod 5 = 0 are held out."""
    model = fit_toxicity(docs, labels, crc_mod("doc_id", 5) != 0)
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
