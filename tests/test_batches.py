"""Batched decoding and edit distances against the same work one at a time."""

import gzip
import random

import numpy as np
import pyarrow as pa

from tastegraph.operators import search
from tastegraph.sources import lists


def test_edit_states_of_a_batch():
    rng = random.Random(3)
    words = ["", "a", "é", "日本語", "x" * 5000, "ab" * 700] + ["".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(150)]
    q, w = zip(*[(a, b) for a in words for b in words if len(a) < 60])
    want = [search.edit_state(a, b) or (-1, -1, -1) for a, b in zip(q, w)]
    assert [tuple(x) for x in search.edit_states(list(q), list(w)).tolist()] == want
    assert search.edit_states([], []).shape == (0, 3)


def test_edit_states_in_small_blocks(monkeypatch):
    monkeypatch.setattr(search, "CELLS", 7)
    q, w = ["abc", "a", "abcdef", "abc", ""], ["abd", "ba", "abdxef", "abcabc", "zz"]
    assert [tuple(x) for x in search.edit_states(q, w).tolist()] == [search.edit_state(a, b) or (-1, -1, -1) for a, b in zip(q, w)]


def packed(raw):
    return gzip.compress(raw, mtime=0)


def test_lists_are_decoded_together_as_one_by_one():
    rng = random.Random(4)
    some = [[[rng.choice([0, 1, 127, 128, 2**31, 2**63 - 1]) for _ in range(4)] for _ in range(rng.randint(0, 30))] for _ in range(60)]
    rows = [lists._packed(x) for x in some]
    rows += [None, b"no", b"", packed(b""), rows[3][:-9], packed(b"\x0a"), packed(b"\x0a\x02\x08"), packed(b"\x0a\x02\x08\x80"), packed(b"\x08\x01"), packed(b"\x0a\x02\x08\x05\x12\x01x"), packed(b"\x0a\x09\x08\x05"), packed(b"\x0a\x02\x28\x05"), packed(b"\x0a\x04\x08\x05\x08\x06"), packed(b"\x0a\x00\x0a\x02\x10\x03")]
    for batch in (rows, rows[60:], rows[:60], rows[60:61], [], rows[::-1]):
        got = lists.unpacked_lists(pa.array(batch, pa.binary())).to_pylist()
        assert got == [lists._unpacked(r) for r in batch]


def test_decoding_a_batch_is_faster():
    import time

    rng = np.random.default_rng(5)
    rows = [lists._packed(rng.integers(0, 40_000, (300, 4)).tolist()) for _ in range(200)]
    column = pa.array(rows, pa.binary())
    times = []
    lists.unpacked_lists(column)
    for read in (lambda: lists.unpacked_lists(column), lambda: [lists._unpacked(r) for r in rows]):
        began = time.perf_counter()
        read()
        times.append(time.perf_counter() - began)
    assert times[0] < times[1] / 2
