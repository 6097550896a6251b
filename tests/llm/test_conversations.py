"""Repair of conversations against a search over all edits, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tastegraph.llm import conversations as C
from tastegraph.llm.queries import op13_conversations


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if d == 4 else role
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    key = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))


def plain(rows):
    """Counts and the cheapest audit of one conversation's rows after damage, by states and whole strings."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(C.SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", [])}  # output initials: "", "s", "..u", "..a" by their last letter
    step = lambda q, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((q, r))

    def add(to, q, v):
        if q is not None and (q not in to or v[:2] < to[q][:2]):
            to[q] = v

    def inserts(states):
        out = dict(states)
        for _ in range(3):
            for q, (c, a, lines) in list(out.items()):
                for r, name in (("u", "user:"), ("a", "assistant:")):
                    add(out, step(q, r), (c + 3, a + "I", [*lines, name]))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for q, (c, a, lines) in inserts(best).items():
            add(after, q, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                add(after, step(q, role[:1]), (c + more, a + "K", [*lines, f"{role}:{text}"]))
                for r, name in (("u", "user"), ("a", "assistant")):
                    add(after, step(q, r), (c + 3 + more, a + "R", [*lines, f"{name}:{text}"]))
        best = after
    c, a, lines = min((v for q, v in inserts(best).items() if q in ("", "a")), key=lambda v: v[:2])
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, c, a, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def want(rows):
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    return {conv: plain(by.get(conv, [])) for conv in {r[0] for r in rows}}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    found = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}
    assert len(out) == len(found)
    return out


def random_rows(n, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", " ", "", "a.\n", "mid. dle", "wörld.", None, "x. \x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "umbrella"]
    out = []
    for conv in [*range(n), None]:
        out += [(conv, r.choice([None, *range(12)]) if r.random() < 0.3 else k, r.choice(roles[:2] if r.random() < 0.8 else roles), r.choice(texts[:3] if r.random() < 0.7 else texts)) for k in range(r.randrange(1, 14))]
    return out


@pytest.mark.parametrize("stretch", [C.STRETCH, 3])
def test_all_edits(spark, stretch):
    rows = random_rows(250, stretch) + [(9999, k, "user" if k % 3 else "assistant", f"Turn {k}." if k % 7 else "cut") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert got(C.repair_digests(df, stretch)) == want(rows)


def test_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_conversations(spark, d)) == want(rows)


def test_extra_columns_repeats_dropped_and_no_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "All."), (5, 1, "user", "Same."), (5, 1, "user", "Same."), (5, 1, "user", "Same."), (6, None, None, None), (7, None, "assistant", "b."), (7, None, "user", "a.")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key string, pid long, at long")
    found = got(C.repair_digests(df))
    assert found == want(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair_digests(df.limit(0)).collect() == []


def test_rules_have_the_product_of_their_rows(spark):
    rows = ["ADAD" * 30 + "GAAB", "ADADADAD", "A", "LCADB"]
    short, value = C.grammar(spark.createDataFrame([(s,) for s in rows], "seq string"))
    for r in short.collect():
        total = value[r["short"][0]]
        for s in r["short"][1:]:
            total = C.joined(total, value[s])
        plain_total = value[r["seq"][0]]
        for s in r["seq"][1:]:
            plain_total = C.joined(plain_total, value[s])
        flat = lambda m: [[e and (e[0], C.text_of(e[1])) for e in line] for line in m]
        assert flat(total[0]) == flat(plain_total[0]) and total[1:] == plain_total[1:]
    assert max(len(r["short"]) for r in short.collect()) < 20
