"""Rows that an earlier form of an operator left out, against brute force on small tables."""

import random

from tastegraph.llm import decontam, lines, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_decontamination_finds_edited_copies_beside_an_exact_one(spark):
    item = [f"q{k}" for k in range(38)]
    edited = ["other" if k in (5, 14, 23, 32) else w for k, w in enumerate(item)]
    short = [f"s{k}" for k in range(15)]
    changed = ["other" if k == 7 else w for k, w in enumerate(short)]
    rows = [(0, " ".join(item)), *((k, f"before {' '.join(edited)} after") for k in range(1, 9))]
    rows += [(10, " ".join(short)), *((k, f"before {' '.join(changed)} after") for k in range(11, 60)), (99, "nothing of it here")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, rows), bench).collect()}
    assert got == {(k, 1) for k in range(9)} | {(k, 2) for k in range(10, 60)}


def test_decontamination_finds_every_seeded_alignment():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    items = [rng.choices(words, k=rng.randrange(3, 30)) for _ in range(25)]
    grams = decontam.ItemGrams([(k, " ".join(ws)) for k, ws in enumerate(items)])
    seen = 0
    for _ in range(150):
        k = rng.randrange(len(items))
        copy = []
        for w in items[k]:
            copy += [w] if (x := rng.random()) < 0.7 else [rng.choice(words)] if x < 0.8 else [w, *rng.choices(words, k=3)] if x < 0.9 else []
        doc = rng.choices(words, k=rng.randrange(0, 60)) + copy + rng.choices(words, k=rng.randrange(0, 60))
        held = list(grams.passages(" ".join(doc)))
        scores = dict.fromkeys(range(len(items)), 0.0)
        for (j, _), s in zip(held, decontam.align([(items[j], ws) for j, ws in held])):
            scores[j] = max(scores[j], s)
        mine = {*zip(doc, doc[1:], doc[2:])}
        for j, want in enumerate(decontam.align([(ws, doc) for ws in items])):
            if want >= decontam.THRESHOLD and j == k and mine & {*zip(items[j], items[j][1:], items[j][2:])}:
                seen += 1
                assert abs(scores[j] - want) < 1e-9
    assert seen > 60


def true_jaccard(a, b):
    x, y = ({s[i : i + 12] for i in range(max(1, len(s) - 11))} for s in (a.lower().strip(" "), b.lower().strip(" ")))
    return len(x & y) / len(x | y)


def test_line_dedup_reads_lines_without_blanks_to_their_end(spark):
    rng = random.Random(8)
    pick = lambda s, n: "".join(rng.choices(s, k=n))
    low, kana = "abcdefghijklmnopqrstuvwxyz", "日本語文章空白全体見必要新聞天気春夏秋冬山川海空のはをにがでと"
    make = [
        lambda: "https://www." + ".".join(pick(low, 7) for _ in range(2)) + "/" + "/".join(pick(low, rng.randrange(3, 9)) for _ in range(30)),
        lambda: "see https://www." + "/".join(pick(low, rng.randrange(3, 9)) for _ in range(30)) + " now",
        lambda: "日本語文章空白全体見必要新" + pick(kana, 180),
        lambda: "first\tsecond\tthird\t" + "\t".join(pick(low, rng.randrange(2, 9)) for _ in range(30)),
        lambda: "sha512:0000000" + pick("0123456789abcdef", 180),
    ]
    base = [m() for m in make for _ in range(12)]
    near = []
    for line in base:  # one character more in the middle moves all that follows
        at = len(line) // 2
        near.append(line[:at] + "q" + line[at:])
    rows = list(enumerate([*base, *near]))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert all(true_jaccard(a, b) >= 0.8 for a, b in zip(base, near))
    assert max(true_jaccard(a, b) for k, a in enumerate(base) for b in base[:k]) < 0.5
    assert all(got[k] == base[k] for k in range(len(base)))
    assert sum(got[len(base) + k] == "" for k in range(len(base))) >= 0.85 * len(base)


def test_pii_finds_written_out_addresses_and_plain_phones():
    w = pii.train()
    held = ["jane.doe at example dot org", "info [at] firm [dot] com", "peter(at)house(dot)net", "Jane.Doe AT Example DOT org", "555-867-5309"]
    texts = [f"{'word ' * 60}write to {x} for more" for x in held]
    found = [{t[s:e] for _, s, e in spans} for t, spans in zip(texts, pii.model_spans(texts, w))]
    assert sum(x in f for x, f in zip(held, found)) >= 4
    clean = ["we met at the river and saw a dot on the map", "look at this. Then go home", "he was at home dot matrix printers are old", "meet me at noon. The dot is red", "order 4839201745 was sent at noon"]
    assert pii.model_spans(clean, w) == [[] for _ in clean]
