"""Operators against brute force, the tokenizer library, exact round trips and held-out labels, on small and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tastegraph.llm import ann, bpe, decontam, html_extract, lines, pii, quality, simhash, token_files, toxicity
from tastegraph.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, lid long, row string, score double, _text string, drops string, id long, times int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "r", 0.5, "x", "d", 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = "the quick brown fox jumps over the lazy dog again and again " * 4000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id text here"), (6, long), (7, long), (8, "İΣ ﬁ é 😀 <|endoftext|> <|startoftext|>"), (2**60 + 1, "a b c d"), (9, "x\n\n\ny")]
    return table(spark, rows)


def empty(spark):
    return table(spark, [])


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    comp = list(range(len(fps)))
    root = lambda i: i if comp[i] == i else root(comp[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    want = {d: (f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, brute_components(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_links_in_large_buckets(spark):
    rng = random.Random(0)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.fingerprint_links(df, chunk=64).collect()]
    at, comp = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))
    root = lambda i: i if comp[i] == i else root(comp[i])
    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        x, y = sorted((root(at[a]), root(at[b])))
        comp[y] = x
    assert [root(i) for i in range(len(fps))] == brute_components(fps)


def test_simhash_odd_tables(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(empty(spark)).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(set([1, 4, 0, 6, 8, 2**60 + 1, 9]))


def brute_lines(rows):
    """Kept text of each row by comparing all pairs of lines exactly."""
    norm = lambda s: s.strip(" ").lower()
    sh = lambda n: {m[1] for m in re.finditer(r"(?s)[^ ]* (?=(.{1,12}))", " " + n)}
    first, order = {}, []
    for d, t in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            n = norm(line)
            if len(n) >= lines.MIN_CHARS and n not in first:
                first[n] = (d, p)
                order.append(n)
    comp = list(range(len(order)))
    root = lambda i: i if comp[i] == i else root(comp[i])
    sets = [sh(n) for n in order]
    for i in range(len(order)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    keep = {n: first[order[root(i)]] for i, n in enumerate(order)}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if len(norm(x)) < lines.MIN_CHARS or keep[norm(x)] == (d, p)) for d, t in rows}


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "theta", "zeta", "epsilon", "iota"]
    base = [" ".join(rng.choices(words, k=rng.randrange(4, 40))) for _ in range(25)]

    def vary(line):
        w = line.split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()

    rows = [(i, "\n".join(vary(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", "}", "short"]) for _ in range(6))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, rows)).collect()}
    want = brute_lines(rows)
    same = sum(got[d] == want[d] for d in want)
    assert same >= 0.95 * len(want)  # banding is approximate; what it links is exact


def test_line_dedup_odd_tables(spark, odd):
    got = lines.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[1] is None and texts[2] == "" and texts[9] == "x\n\n\ny" and texts[7] == "" and len(texts[6]) > 1000
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_runs_no_python(docs):
    found = lines.distinct_lines(lines._occurrences(docs))
    plan = lines.candidate_pairs(found, lines.large_bands(found))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_components_hold_every_similar_pair_of_a_band(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "LAGS", 1)
    monkeypatch.setattr(lines, "CHUNK", 3)
    rng = random.Random(11)
    tails = [f"{a} {b}" for a in ("red", "blue", "green", "black") for b in ("one", "two", "three", "four", "five", "six")]
    heads = ["the committee of the northern harbour will", "every visitor must sign the long register and"]
    text = [f"{rng.choice(heads)} {' '.join(rng.choices(tails, k=rng.randrange(1, 4)))}" for _ in range(420)]
    occurrences = lines._occurrences(table(spark, list(enumerate(text))))
    found = lines.distinct_lines(occurrences)
    got = {r["node"]: r["component"] for r in lines.line_components(occurrences, found).collect()}
    sets = {r["lid"]: set(r["s"]) for r in occurrences.select("lid", lines.shingle_hashes("n").alias("s")).collect()}
    bands = {r["lid"]: set(r["bands"]) for r in found.select("lid", "bands").collect()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    linked = {i: find(i) for i in ids if any(j != i and find(j) == find(i) for j in ids)}
    assert got == linked and len(set(linked.values())) > 1
    assert found.select(F.explode("bands").alias("b")).groupBy("b").count().agg(F.max("count")).first()[0] > 20


def test_token_files_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for df in (docs, odd):
        got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digests(df, path).collect()))
        at, want = 0, []
        for d, t in sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
            want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    assert token_files.token_digests(empty(spark), path).count() == 0


def test_token_file_format(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/t"
    token_files.write_token_files(odd, folder, tokenizer_path("byte_bpe_50k.json"), seq_len=16)
    part = spark.read.parquet(f"{folder}/manifest").where("n_tokens > 1").first()["part"]
    batch = token_files.open_token_file(folder, part).get_batch(0)
    assert batch.schema.field("ids").type.list_size == 16 and batch.column("mask").values.to_pylist()[0] is True


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = (quality.quality_scores if kind == "quality" else toxicity.toxicity_scores)(docs, labels)
    p = found.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(p["score"].to_numpy(), p[kind].to_numpy()) > (0.97 if kind == "quality" else 0.85)


def test_classifiers_odd_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 1, 1), (7, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        for l in (labels, none):
            got = f(odd, l).collect()
            assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
            assert 2**60 + 1 in {r["doc_id"] for r in got}
        assert f(empty(spark), labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_prior_estimate():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(quality.estimate_prior(pos[:2000], np.concatenate([pos[2000:3400], neg[:600]])) - 0.7) < 0.08


def test_ann_recall_and_odd_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = v.toPandas()
    x, ids = np.array(p["embedding"].tolist(), float), p["vec_id"].to_numpy()
    got = ann.nearest(v).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[k]
        s[k] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]])
        mine = got[got["query_id"] == ids[k]].sort_values("rank")
        assert np.allclose(mine["score"], [s[ids == i][0] for i in mine["vec_id"]]) and mine["score"].is_monotonic_decreasing
        hit, total = hit + len(want & set(mine["vec_id"])), total + 5
    assert hit >= 0.9 * total
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [1.0, None, 0.0]), (6, [2.0, 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0])]
    few = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 6, 1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", m.start(), m.end())] if 13 <= len(d) <= 19 and pii.luhn(d) else []
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_and_added_ones(spark, odd):
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("ab@.1 -+(25") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)
    texts = [(1, "é mail a.b@c.org and 4783037614295779, +1 (367) 555-9476 from 10.0.0.1"), (2, None), (3, "")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(table(spark, texts)).collect()}
    spans = brute_spans(texts[0][1])
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
    assert set(f"{k}:{s}:{e}" for k, s, e in spans) <= set(got[1]["spans"].split(",")) and got[2]["spans"] == got[3]["spans"] == ""
    test = [pii.sample_sentence(random.Random(k)) for k in range(200)]
    found = pii.model_spans([t for t, _ in test], pii.train())
    right = sum(len(set(a) & set(b)) for (_, a), b in zip(test, found))
    assert right > 0.6 * sum(len(a) for _, a in test) and right > 0.8 * sum(map(len, found))
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(empty(spark)).count() == 0


def brute_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(a))


def test_decontamination(spark, odd):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    pairs = [(rng.choices(words, k=rng.randrange(1, 12)), rng.choices(words[:8], k=rng.randrange(1, 30))) for _ in range(60)]
    assert np.allclose(decontam.align(pairs), [brute_alignment(a, b) for a, b in pairs])
    many = [f"t{k}" for k in range(3000)]
    items = [" ".join(rng.choices(many, k=25)) for _ in range(30)]
    clean = [(k, " ".join(rng.choices(many, k=200))) for k in range(40)]

    def edit(item):
        w = item.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(many)
        return " ".join(w)

    dirty = [(100 + k, " ".join(rng.choices(many, k=150)) + " " + (items[k] if k % 2 else edit(items[k])) + " " + " ".join(rng.choices(many, k=50))) for k in range(30)]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "two words"), (None, "x y z")], "item_id long, text string")
    df = table(spark, clean + dirty)
    for size in (decontam.SLICE_CHARS, 700):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench, slice_chars=size).collect()}
        assert got == {(100 + k, k) for k in range(30)}
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, _ in clean}
    assert decontam.drop_contaminated(odd, bench).count() == odd.count() and decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(df, bench.where("item_id < 0")).count() == 0


def test_html_extraction(spark):
    rng, right = random.Random(9), 0
    for _ in range(60):
        page = html_extract.template_page(rng)
        right += html_extract.extract([page], html_extract.train())[0] == "\n\n".join(html_extract.labelled_nodes(page)[2])
    assert right >= 40
    page = "<html><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>Title</h1><p>Some  <b>text</b> &amp; more\nof it here.</p><p>And a second part of the story.</p></article><footer>&copy; Us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>un<b>closed <div class='ad'>x", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    assert got[1]["text"] == "Title\n\nSome text & more of it here.\n\nAnd a second part of the story." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and html_extract.extract_pages(df.where("page_id < 0")).count() == 0


def test_html_decoding_never_contradicts():
    rng = random.Random(4)
    nodes, _ = html_extract.parse(html_extract.template_page(rng))
    kept = html_extract.decode(nodes, np.random.default_rng(0).normal(0, 2, len(nodes)))
    assert all(kept[n.up] for n, k in zip(nodes[1:], kept[1:]) if k)


def test_bpe_matches_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe.WordBpe.of(path)
    tok.no_truncation()
    tok.no_padding()
    rng = random.Random(1)
    pool = "aAbBsSΣςİıé́ '\n\t\x1c <|>endoftext0１½²_!?-ßﬁ日😀‍"
    for t in ["", "aaaa aaa", "don't I'LL 'ſ", *("".join(rng.choice(pool) for _ in range(40)) for _ in range(1500))]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, odd):
        got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.code_documents(df, path).collect())
        want = []
        for r in df.collect():
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"] or -1, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
        assert [g for g in got if g[0]] == [w for w in sorted(want) if w[0]]
    assert bpe.code_documents(empty(spark), path).count() == 0


def test_pipeline_runs_and_filters(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DATA)
    ids = [r["doc_id"] for r in got.collect()]
    assert 0 < len(ids) < spark.read.parquet(f"{DATA}/documents.parquet").count() and len(set(ids)) == len(ids)


def test_quality_features_read_whole_texts_alike():
    loop = quality.features("one two " * 100)
    long = quality.features("one two " * 5000)
    at = [k for k, x in enumerate(loop) if x == 1.0 and long[k] == 1.0]
    plain = quality.features(" ".join(f"w{i}" for i in range(10000)))
    assert any(plain[k] == 0.0 for k in at)  # the share of words that stand again, at every length
