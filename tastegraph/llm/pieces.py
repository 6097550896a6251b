"""A bounded memory of the ids of text pieces, asked with dictionary-encoded Arrow arrays."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Characters of texts that are encoded together.
BLOCK_CHARS = 1 << 20
#: White space but the blank and the line end.
RARE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def blocks(texts: list[str], size: int = BLOCK_CHARS) -> list[list[str]]:
    """Texts in order, in runs of about ``size`` characters; a longer text is a run of its own."""
    out, held = [], 0
    for t in texts:
        if not out or held + len(t) > size:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out


class PieceMemo:
    """Ids of pieces, learned once; emptied when it has grown to about ``limit`` bytes."""

    def __init__(self, kind: type, limit: int):
        self.kind, self.limit = kind, limit
        self.forget()

    def forget(self) -> None:
        """Piece k has the ids flat[edge[k] : edge[k + 1]]."""
        self.known: dict[str, int] = {}
        self.flat, self.edge, self.held = np.zeros(0, self.kind), np.zeros(1, np.int64), 0

    def keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.edge) - 1
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.flat = np.concatenate([self.flat, ids.astype(self.kind, copy=False)])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
        self.held += 150 * len(pieces) + sum(map(len, pieces)) + self.flat.itemsize * len(ids)

    def gather(self, pieces: pa.Array, learn: Callable[[list[str]], None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids up to the end of each); ``learn`` keeps those not known."""
        if self.held > self.limit:
            self.forget()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if (place < 0).any():
            learn([distinct[k] for k in np.flatnonzero(place < 0)])
            place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return spliced(self.flat, self.edge, place[coded.indices.to_numpy()])


def spliced(flat: np.ndarray, edge: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[edge[r] : edge[r + 1]] of ``rows`` end to end, and where each ends."""
    first = edge[rows]
    sizes = edge[rows + 1] - first
    until = np.cumsum(sizes)
    return flat[np.repeat(first - until + sizes, sizes) + np.arange(until[-1] if len(until) else 0)], until
