"""Byte-pair encoding with word ends, and decoding, in batched numpy merge rounds.

The symbols of all words that a batch adds lie in one flat array. A round looks every
adjacent pair up by binary search among the sorted keys of the merge table, takes each
word's lowest-ranked pair, joins all its occurrences from left to right and compacts the
array; rounds go on until no word has a known pair. Words seen before come from a memory of
each worker that is bounded in bytes. Nothing here calls a tokenizer library.

Normalisation, splitting and special tokens follow the vocabulary file: NFC, white space to
blanks, character-wise lower case, then contractions, letter runs, single digits and runs of
other marks; the strings of special tokens in a text become their ids.

Nulls, blanks: a null text counts as empty; empty and blank texts give no ids and an empty
decoded text. Rows that repeat are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import map_rows
from tastegraph.llm.pieces import RARE, PieceMemo, blocks, spliced

#: Bytes that a worker's memory of white-space-free pieces may take, about.
MEMO_BYTES = 64 << 20
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[^{_SPACE}]+")


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes, as byte-level vocabularies name them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """The vocabulary's tables, the merge rounds and the memory of pieces."""

    _known: dict[str, WordBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        signs = byte_alphabet()
        self.inner = np.array([vocab.get(signs[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(signs[b] + self.suffix, -1) for b in range(256)], np.int64)
        self.base, merges = size, [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.names = pa.array(map(str, range(size)), pa.string()), pa.array(self.tokens, pa.string())
        self.memo = PieceMemo(np.int32, MEMO_BYTES)

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, given as their UTF-8 bytes, in order, and where each word's begin and the last ends."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, owner = self.inner[raw], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        ends = ends[size > 0]
        sym[ends] = self.final[raw[ends]]
        done_sym, done_owner, done_pos = [], [], []
        pos = np.arange(len(sym))
        far = np.int64(1 << 40)
        while len(sym):
            same = np.zeros(len(sym), bool)
            same[:-1] = owner[1:] == owner[:-1]
            rank = np.full(len(sym), far)
            at = np.flatnonzero(same)
            key = sym[at] * self.base + sym[at + 1]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[slot] == key
            rank[at[hit]] = self.ranks[slot[hit]]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, first)
            width = np.diff(np.concatenate((first, [len(sym)])))
            least = np.repeat(best, width)
            over = least == far
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                done_pos.append(pos[over])
            take = (rank == least) & ~over
            # Of overlapping occurrences (a a a) the leftmost wins: keep those an even way into their run.
            step = np.flatnonzero(take)
            if len(step):
                head = np.concatenate(([True], np.diff(step) != 1))
                since = np.arange(len(step)) - np.maximum.accumulate(np.where(head, np.arange(len(step)), 0))
                step = step[since % 2 == 0]
                sym[step] = self.made[rank[step]]
            gone = np.zeros(len(sym), bool)
            gone[step + 1] = True
            stay = ~gone & ~over
            sym, owner, pos = sym[stay], owner[stay], pos[stay]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, owner, pos = np.concatenate(done_sym), np.concatenate(done_owner), np.concatenate(done_pos)
        order = np.argsort(pos, kind="stable")
        sym, owner = sym[order], owner[order]
        keep = sym >= 0
        sym, owner = sym[keep], owner[keep]
        return sym, np.searchsorted(owner, np.arange(len(words) + 1))

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of new white-space-free pieces into the memory."""
        words: dict[str, int] = {}
        parts, counts, marks = [], [], list(self.special.values())
        for p in pieces:
            low = lowered(p)
            if low.isalpha():
                parts.append(words.setdefault(low, len(words)))
                counts.append(1)
                continue
            before = len(parts)
            for x in self.cut.split(p) if self.cut and "<" in p else [p]:
                if x in self.special:
                    parts.append(-1 - marks.index(self.special[x]))
                else:
                    parts += [words.setdefault(w, len(words)) for w in self.pattern.findall(lowered(x))]
            counts.append(len(parts) - before)
        flat, edge = self.merge([w.encode() for w in words])
        # Special tokens stand behind the words, one id each.
        flat, edge = np.concatenate([flat, np.array(marks, np.int64)]), np.concatenate([edge, edge[-1] + np.arange(1, len(marks) + 1)])
        at = np.array(parts, np.int64)
        ids, until = spliced(flat, edge, np.where(at < 0, len(words) - 1 - at, at))
        ends = np.concatenate(([0], until))[np.cumsum([0, *counts])]
        self.memo.keep(pieces, ids, np.diff(ends))

    def code_batch(self, texts: list[str]) -> Iterator[tuple[pa.ListArray, pa.Array, pa.Array]]:
        """For blocks of texts in order: ids of each text, their decimals joined by blanks, the decoded texts."""
        for part in blocks(texts):
            clean = [t if t.isascii() else unicodedata.normalize("NFC", t) for t in part]
            clean = [" ".join(_PIECE.findall(t)) if RARE.search(t) else t.replace("\n", " ") for t in clean]
            cut = pc.split_pattern(pa.array(clean, pa.large_string()), " ")
            ids, until = self.memo.gather(cut.flatten(), self.learn)
            ends = np.concatenate(([0], until))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
            of = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            text, token = (pc.binary_join(of(names.take(pa.array(ids))), " ") for names in self.names)
            yield of(pa.array(ids)), text, token

    def encode(self, text: str) -> list[int]:
        return next(self.code_batch([text]))[0][0].as_py()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as the library decodes where a vocabulary names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


def lowered(text: str) -> str:
    """Lower case character by character (no final-sigma rule)."""
    return text.replace("Σ", "σ").lower()


def code_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``with_text`` also ``ids array<int>, decoded``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sha = lambda texts: [hashlib.sha256(s).hexdigest() for s in texts.cast(pa.binary()).to_numpy(zero_copy_only=False)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe.of(tokenizer)
        for pdf in batches:
            at = 0
            for ids, text, decoded in bpe.code_batch(pdf["text"].tolist()):
                out = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(ids)].to_numpy(), "n_tokens": pc.list_value_length(ids).to_numpy(), "ids_sha256": sha(text), "decoded_sha256": sha(decoded)})
                if with_text:
                    out["ids"], out["decoded"] = ids.to_pylist(), decoded.to_pylist()
                at += len(ids)
                yield out

    return map_rows(source, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else ""))
