"""Long, repeated, contradictory and clashing input, against brute force or the library."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegraph.llm import ann, bpe, decontam, html_extract, lines, pii, quality, simhash, token_files, toxicity
from tastegraph.llm.queries import tokenizer_path

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = f"{PLAIN}, _id long, _of string, label int, row string, key string, lid long, s string, drops string, score double, _m long, _h long"


def docs(spark, rows, schema=PLAIN):
    more = (1, "o", 2, "r", "k", 3, "s", "d", 0.5, 4, 5) if schema == CLASH else ()
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), *more) for i, t in rows], schema)


def test_token_files_of_long_documents(spark):
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(4)
    tok = Tokenizer.from_file(path)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(3000)]
    rows = [(1, " ".join(rng.choices(words, k=150_000))), (2, "x"), (3, " ".join(rng.choices(words, k=70_000))), (4, "a \n\n b"), (5, ""), (5, "two"), (5, "one"), (None, "none")]
    assert len(tok.encode(rows[0][1]).ids) > 300_000
    folder = token_files.scratch_path(spark, "t")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digests(docs(spark, rows, CLASH).coalesce(1), path, folder=folder).collect())
    want = {(d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, t in rows for ids in [[*tok.encode(t, add_special_tokens=False).ids, 2]]}
    assert {g[1:] for g in got} == want and [g[1] for g in got] == [None, 1, 2, 3, 4, 5, 5, 5]
    assert all(b[0] == a[0] + a[2] for a, b in zip(got, got[1:]))
    for part in {r["part"] for r in spark.read.parquet(f"{folder}/manifest").collect()}:
        reader = token_files.open_token_file(folder, part)
        sizes = [reader.get_batch(k).num_rows for k in range(reader.num_record_batches)]
        assert all(n == token_files.BATCH_SEQS for n in sizes[:-1]) and sizes[-1] <= token_files.BATCH_SEQS


def test_token_ids_of_random_text_are_the_library_s():
    enc, rng = token_files.PieceEncoder.of(tokenizer_path("byte_bpe_50k.json")), random.Random(1)
    pool = "aAbB ,.'s\n\n  \t\x1céΣ日１9½<|>endoftext　\xa0\0"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(6000)] + ["".join(rng.choice("ab \n'") for _ in range(rng.randrange(20))) for _ in range(6000)]
    got = []
    for ids, sizes in enc.encode(texts, 2):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [[*enc.tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_memories_forget_and_give_the_same(monkeypatch):
    texts = [" ".join(f"word{k * 7 % 900}x" for k in range(n, n + 60)) for n in range(0, 3000, 60)]
    for make, codes in ((lambda: bpe.WordBpe(tokenizer_path("word_bpe_49k.json")), lambda e: [x.as_py() for t in texts for x in next(e.code_batch([t]))[0]]), (lambda: token_files.PieceEncoder(tokenizer_path("byte_bpe_50k.json")), lambda e: [next(e.encode([t], 2))[0].tolist() for t in texts])):
        full, small = make(), make()
        small.memo.limit = 3000
        assert codes(full) == codes(small) and len(small.memo.known) < len(full.memo.known)


def test_classifiers_with_clashing_columns_and_contradictory_labels(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["good", "plain", "words", "here"], k=40))) for k in range(30)] + [(k, "!! ## " * 30) for k in range(30, 60)] + [(7, "again")] * 300
    labels = [(k, int(k < 30), int(k >= 30), "x") for k in range(60)] + [(9, 0, 0, "x"), (9, None, None, "y")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, _most string")
    df = docs(spark, rows, CLASH)
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(df, table).count() == len(rows)
    kept = quality.keep_good(df, table)
    assert kept.columns == df.columns
    used = quality.labelled_texts(df, table, "quality", F.lit(True), 100, only=1).collect()
    assert {r["doc_id"] for r in used} == set(range(30)) - {9} and len(used) == 29
    assert quality.keep_good(df.where("doc_id < 0"), table).count() == 0


def test_nearest_by_slices_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(400)] + [(50, rng.normal(size=8).tolist()), (51, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df).collect()))
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 200)
    assert sorted(map(tuple, ann.nearest(df).collect())) == whole
    least = np.array(min(x for i, x in rows if i == 50))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    best = sorted(((-float(unit(x) @ unit(least)), i) for i, x in rows if i != 50))[:5]
    assert [r[2] for r in whole if r[0] == 50] == [i for _, i in best]


def test_pii_windows_of_long_texts():
    w, filler = pii.train(), "plain words without any sign of it "
    held = "write to jane.doe [at] example [dot] org now"
    for before in (0, 100, 128, 150, 170, 190, 2000):
        text = ("x" * before + " ") + held + " " + filler * 200
        assert "jane.doe [at] example [dot] org" in {text[s:e] for _, s, e in pii.model_spans([text], w)[0]}
    took = []
    for n in (60_000, 240_000):
        text = "call 5 of 7 @ nine, " * (n // 20)
        began = time.process_time()
        pii.model_spans([text], w)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0]


def test_html_of_broken_pages():
    parse = html_extract.parse
    texts = lambda page: [t for _, t in parse(page)[1]]
    assert texts("<p>one</p><button>Go<p>two</p><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><iframe src=x><p>two</p>") == ["one", "two"]
    assert texts('<p title="x>first paragraph</p><p>second</p>')[-1] == "second"
    assert texts("<p>one</p><script>var t = '<p>no</p>';") == ["one"]
    began = time.process_time()
    nodes, _ = parse("<div>" * 20_000 + "</section>" * 20_000 + "<li>x" * 2000)
    assert len(nodes) == 22_001 and time.process_time() - began < 5


def test_decontamination_of_frequent_grams(monkeypatch):
    rng = random.Random(5)
    items = [(k, " ".join(["the end of", *rng.choices([f"w{n}" for n in range(50)], k=9)])) for k in range(60)]
    grams = decontam.ItemGrams(items)
    text = "the end of " * 50 + items[3][1] + " and " + "the end of " * 50 + items[41][1]

    def found():
        held = list(grams.passages(text))
        return {k for (k, _), s in zip(held, decontam.align([(grams.items[k][1], ws) for k, ws in held])) if s >= 0.5}

    whole = found()
    assert {3, 41} <= whole
    monkeypatch.setattr(decontam, "EXPANDED", 500)
    assert found() == whole


def test_lines_without_blanks_and_hashes_are_told_apart(spark):
    rows = [(1, "https://example.com/articles/one-thing"), (2, "https://example.com/articles/quite-another"), (3, "checksum: 9f86d081884c7d659a2feaa0c55ad015"), (4, "checksum: 9f86d081884c1111b3d1b92c8f0e4a77"), (5, "日本語文章空白全体見必要新聞天気"), (6, "日本語文章空白全体見必要春夏秋冬")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows, CLASH)).collect()}
    assert got == dict(rows)


def test_line_recall_against_all_characters(spark):
    """Pairs at 0.8 or more by every 12-character stretch of a line, most of which share their component."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randrange(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randrange(25, 60))) for _ in range(150)]

    def edited(line):
        w = line.split()
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    near = [edited(x) for x in base]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, list(enumerate(base + near)))).collect()}
    cut = lambda s: {s[i : i + 12] for i in range(len(s) - 11)}
    alike = [k for k, (a, b) in enumerate(zip(base, near)) if len(cut(a) & cut(b)) >= 0.8 * len(cut(a) | cut(b))]
    assert len(alike) > 60 and sum(got[150 + k] == "" for k in alike) >= 0.9 * len(alike)
    assert all(got[k] == base[k] for k in range(150))


def test_near_duplicates_of_an_empty_table(spark):
    none = docs(spark, [], CLASH)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for got in (simhash.keep_first(none), lines.dedup_lines(none), decontam.drop_contaminated(none, bench)):
        assert got.columns == none.columns and got.count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_documents(spark, tmp_path, empty):
    import corpus_pipeline

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [] if empty else [(10**6 + 1, None), (10**6 + 2, ""), (None, "a line that has no id but some words in it"), (10**6 + 3, "x" * 50_000), (10**6 + 4, "the same words\n" * 3000), (10**6 + 4, "the same words\n" * 3000)]
    odd = real.limit(0 if empty else 80).unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], PLAIN)).withColumns({"_id": F.lit(1), "lid": F.lit("l"), "row": F.lit("r")})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, n = at.columns, at.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = corpus_pipeline.materialize(stage(spark, at, str(tmp_path)), name)
        assert at.count() <= n and (k == 4 or at.columns == names)
    assert empty or sorted(map(str, at.collect())) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
