"""Line dedup by every stretch of 12 characters, against the Jaccard of all of them."""

import random

import pytest

from tastegraph.llm import lines
from tastegraph.llm.queries import op2_line_dedup

RNG = random.Random(21)
WORDS = ["".join(RNG.choices("abcdefghijklmnoprstuvwz", k=RNG.randrange(2, 9))) for _ in range(2000)]


def words(low, high):
    return " ".join(RNG.choices(WORDS, k=RNG.randrange(low, high + 1)))


def stretches(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def jaccard(a, b):
    x, y = stretches(a), stretches(b)
    return len(x & y) / len(x | y)


def inserted(line):
    k = RNG.randrange(len(line))
    return line[:k] + "q" + line[k:]


def replaced(line):
    w = line.split()
    w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


EDITS = {
    "a word appended": (8, 14, lambda s: f"{s} {RNG.choice(WORDS)}"),
    "ok appended": (8, 14, lambda s: s + " ok"),
    "a full stop appended": (8, 14, lambda s: s + "."),
    "two words appended": (16, 24, lambda s: f"{s} {RNG.choice(WORDS)} {RNG.choice(WORDS)}"),
    "a word before": (16, 24, lambda s: f"{RNG.choice(WORDS)} {s}"),
    "a character inserted": (22, 30, inserted),
    "a word replaced": (25, 40, replaced),
}


def test_query_joins_alike_lines_and_no_others(spark, tmp_path):
    pairs = [(kind, a, edit(a)) for kind, (low, high, edit) in EDITS.items() for a in (words(low, high) for _ in range(150))]
    # Ninety equal characters and eight different words each: unlike by all stretches.
    pairs += [("unlike", "".join(RNG.choices("日本語文章空白全体見必要新聞天気", k=90)) + " ", "") for _ in range(20)]
    pairs = [(k, a + words(8, 8), a + words(8, 8)) if k == "unlike" else (k, a, b) for k, a, b in pairs]
    rows = [(i, t) for i, t in enumerate([t for _, a, b in pairs for t in (a, b)])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert all(got[2 * i] == a for i, (_, a, _) in enumerate(pairs))
    for kind in [*EDITS, "unlike"]:
        at = [i for i, p in enumerate(pairs) if p[0] == kind]
        alike = [i for i in at if jaccard(*pairs[i][1:]) >= 0.8]
        assert sum(got[2 * i + 1] == "" for i in alike) >= 0.9 * len(alike), kind
        assert all(got[2 * i + 1] == pairs[i][2] for i in at if i not in alike), kind


def test_stretches_are_those_of_the_line_at_every_position(spark):
    text = ["a" * 11, "abcdefghijkl", "x y\tz 日本語 \U0001f600\U0001f601 and so on to the end.", "tail " * 40]
    df = spark.createDataFrame([(t,) for t in text], "n string")
    for r in df.select("n", lines.shingle_hashes("n", lines.stretches).alias("s")).collect():
        want = {h for (h,) in spark.createDataFrame([(x,) for x in stretches(r.n)], "x string").selectExpr("hash(x)").collect()}
        assert r.s == sorted(want)


@pytest.mark.parametrize("size", [30, 300, 1500])
def test_maps_tell_no_alike_lines_apart(spark, size):
    base = [words(size // 5, size // 5) for _ in range(12)]
    text = base + [replaced(x) for x in base] + [x + "." for x in base] + [inserted(x) for x in base]
    df = spark.createDataFrame(list(enumerate(text)), "lid long, n string").repartition(4)
    pairs = spark.createDataFrame([(a, b) for a in range(len(text)) for b in range(a)], "a long, b long")
    got = {(r.a, r.b) for r in lines.line_links(pairs, lines.mapped(df, lines.stretches), shingles=lines.stretches).collect()}
    assert got == {(a, b) for a in range(len(text)) for b in range(a) if jaccard(text[a], text[b]) >= 0.8}


def test_minima_are_those_of_all_stretches_in_their_order(spark):
    """Against the order of all stretches, first letters before others; lines with enough, few and none of these."""
    text = ["a" * 11, "abcdefghijkl", "tail " * 40, "o" * 300, "o" * 300 + " x", "日本語文章空白" * 9, "so\tgo \U0001f600 " * 20, *(words(2, 60) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in text], "n string")
    for r in lines.with_minima(df, lines.stretches).collect():
        parts = sorted(stretches(r.n))
        hashes = [x.h for x in spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p string").selectExpr("i", "hash(p) h").orderBy("i").collect()] if len(r.n) < 70 else None
        if hashes:
            want = sorted(range(len(parts)), key=lambda i: (len(parts[i]) < 12 or parts[i][0] not in lines.FIRST, hashes[i]))
            assert r.s[:8] == [hashes[i] for i in want][:8]
            assert len(r.s) == len(parts) or len(r.s) >= 8
    few = lines.with_minima(df.where("length(n) >= 300"), lines.stretches).where("size(s) > 8 and n not like 'oooo%'")
    assert few.count() == 0  # long lines are not hashed at every position for their minima
