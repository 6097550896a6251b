"""Byte-level BPE against the tiktoken library: random texts, odd tables, long pieces."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tastegraph.llm import byte_bpe
from tastegraph.llm.queries import op11_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n: int) -> list[str]:
    r = random.Random(11)
    pools = [
        lambda: chr(r.randrange(32, 127)),
        lambda: r.choice(" \t\n\r\x0b\x85\xa0  　'sdt"),
        lambda: chr(r.choice([r.randrange(0x80, 0xD800), r.randrange(0xE000, 0x20000), r.randrange(0x20000, 0x33000)])),
        lambda: r.choice("aàéßçñ0٣Ⅷ-—…😀漢字かな한글\U00031350\U00010d40"),
        lambda: r.choice("etaoin shrdlu"),
    ]
    out = []
    for _ in range(n):
        own = r.sample(pools, r.randrange(1, 4))
        out.append("".join(r.choice(own)() for _ in range(r.choice([0, 1, 3, 20, 200]))))
    digits = "".join(r.choice("abcdefghijABCDEFG0123456789+/") for _ in range(20_000))
    return [*out, "-" * 5000, "a" * 3000 + " " * 700 + "b", digits, "漢字" * 3000, "it's I'll you've<|endoftext|>  x", "<|endoftext|>"]


def test_ids_and_bytes_are_the_librarys(spark, library):
    rows = list(enumerate(texts(1500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.code_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        want, r = library.encode_ordinary(text), got[k]
        assert (r.ids, bytes(r.decoded), r.n_tokens) == (want, text.encode(), len(want)), repr(text[:60])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(want)).hexdigest()


def test_query_on_the_given_table(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_byte_bpe(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))


def test_nulls_repeats_extra_columns_and_no_rows(spark, library):
    rows = [(None, None, "x", 1), (1, None, None, 2), (1, "", "y", 3), (2, "one two", "z", 4), (2, "one two", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string, word long")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in byte_bpe.code_documents(docs, RANKS, public_tokenizers.PATTERN).collect())
    empty = hashlib.sha256(b"").hexdigest()
    two = hashlib.sha256(" ".join(map(str, library.encode_ordinary("one two"))).encode()).hexdigest()
    assert got == [(0, 0, empty), (1, 0, empty), (1, 0, empty), (2, 2, two), (2, 2, two)]
    assert byte_bpe.code_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = byte_bpe.code_documents(docs, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "PythonUDF"))


def test_pieces_are_the_same_with_and_without_newer_classes(spark):
    pattern = public_tokenizers.PATTERN
    rows = [(t, k) for k in (0, 1) for t in (x + "\U00031350\U00010d40" * k for x in texts(400))]
    df = spark.createDataFrame(rows, "text string, newer int")
    cut = byte_bpe.F.regexp_extract_all("text", byte_bpe.F.lit(byte_bpe.java_pattern(pattern)), byte_bpe.F.lit(0))
    assert df.where(byte_bpe.pieces(byte_bpe.F.col("text"), pattern) != cut).count() == 0
    assert df.where("newer = 1").where(~byte_bpe.F.col("text").rlike(byte_bpe.NEWER)).count() == 0


def test_common_words_are_looked_up_and_codes_stay_apart(spark, library):
    """Texts that look like ids, blanks and ends of codes, as common words and as others."""
    base = [" 12", "12 13", "\u0100 7\u0101", "\u0101\u0100", " \u0100", "0\u0101 9\u0100x", "\x00\x01\xff"]
    rows = list(enumerate([*base, *base, "a" + base[1], " 12" * 500]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.code_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    assert got == {k: (library.encode_ordinary(t), t.encode()) for k, t in rows}
    assert byte_bpe.COMMON_WORDS >= 131_072  # seven words of a hundred are then folded, not sixteen
