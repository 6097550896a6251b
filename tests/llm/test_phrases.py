"""Phrase collocations against a count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tastegraph.llm import phrases
from tastegraph.llm.phrases import collocations, quicksort
from tastegraph.llm.queries import op12_phrases


def brute(rows, least, longest, first):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= least}
    inside = set()
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            inside |= {(lang, p[i : i + size]) for i in range(len(p) - size + 1) if often[lang, p[i : i + size]] == a}
    out = {}
    for (lang, p), a in often.items():
        if len(p) > 1 and (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:first], 1)}


def texts(n, seed):
    r = random.Random(seed)
    words = ["The", "of", "and", "straße", "Ünder", "a b", "x", "y", "z", "漢字", "i", "ii"]
    return [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(r.randrange(60)))) for _ in range(n)]


def as_rows(df):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("group_rows", [phrases.GROUP_ROWS, 40])
def test_all_phrases(spark, group_rows, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 3000)
    rows = texts(300, 1) + [("en", None), (None, ""), ("en", "x y z x y z " * 200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert as_rows(collocations(docs, least=12, first=50, group_rows=group_rows)) == brute(rows, 12, 5, 50)


def test_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert as_rows(op12_phrases(spark, d)) == brute(rows, 100, 5, 2000)


def test_nulls_extra_columns_and_no_rows(spark):
    rows = [(None, "a b " * 3, 1, "q", 9), ("und", "A B", 2, "q", 8), ("en", None, 3, None, 7), (None, " . ", 4, "q", 6)]
    docs = spark.createDataFrame(rows, "lang string, text string, sym long, phrase string, n long")
    got = as_rows(collocations(docs, least=4))
    assert got == brute([(r[0], r[1]) for r in rows], 4, 5, 2000) and ("und", 1, "a b", 4, 4, 4, 8, 2000) in got
    assert collocations(docs.limit(0)).collect() == []


def test_shared_hashes_are_told_apart(spark, monkeypatch):
    real = phrases._symbol
    monkeypatch.setattr(phrases, "_symbol", lambda lang, word, seed: real(lang, "one" if seed == 0 else word, seed))
    docs = spark.createDataFrame([("en", "a b c " * 5)], "lang string, text string")
    assert phrases.word_counts(docs)[1] == 1


def test_quicksort_leaves_light_partitions():
    r = np.random.default_rng(3)
    columns = [r.integers(1, 4, 500).astype(np.uint64) for _ in range(3)]
    weight = r.integers(1, 5, 500)
    want = Counter()
    for row, w in zip(zip(*columns), weight):
        for k in (2, 3):
            want[tuple(map(int, row[:k]))] += int(w)
    got = {tuple(int(c[row]) for c in columns[:k]): n for row, k, n in quicksort(columns, weight, 60)}
    assert got == {p: n for p, n in want.items() if n >= 60}
    assert phrases._runs([c[:0] for c in columns], weight[:0]) == []
