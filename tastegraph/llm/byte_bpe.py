"""Byte-level BPE by ranks, and decoding, in Spark's higher-order functions.

A text is cut into pieces by the pattern of the vocabulary. A piece is the string of its bytes'
ids, one character each; the merges that may apply to it are looked up at each of its bytes in
a literal map, sorted by rank and folded over the string, each replacing a pair by its token.
A merge whose pair does not stand there when its turn comes changes nothing, so a list with
merges too many is as good. In such a vocabulary a token's parts have lower ranks than itself,
so one pass in the order of ranks is the whole encoding. Decoding concatenates the bytes of
the ids.

Spark looks a key up in a map literal by going through all of its keys, so the maps are dealt
by hash into an array of small ones. Common words, of a bounded sample of documents, are
encoded once for all and stand in such a map too; other words are encoded where they occur.
Which words these are decides about speed alone, never about a result. A code is one string,
for each token a blank, its id, ID_END, its bytes and BYTES_END; a document's ids and bytes are
what is left of the codes of its words without the other.

Texts without the letters and numbers that an older JVM does not know are cut by its own classes.

Nulls, blanks: a null text counts as empty; an empty text has no ids and decodes to no bytes. Rows
that repeat are encoded each. Other columns, whatever their names, take no part. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents (about) whose words are counted to choose the common ones, and how many of these are kept.
SAMPLE_DOCS, COMMON_WORDS = 20_000, 131_072
#: A token longer than this many bytes is a candidate wherever its first bytes stand.
DEPTH = 5
#: Stands before ids as characters; ids stay below the surrogates.
BASE = 256
#: Ends of an id and of a token's bytes in a code; no byte is such a character.
ID_END, BYTES_END = "\u0100", "\u0101"

# Letters and numbers of Unicode 14 to 16, which an older JVM does not know as such.
LETTERS = """870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4
10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA
10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746
11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF
1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0
1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF""".split()
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA".split()


def _ranges(parts: list[str]) -> str:
    return "".join("-".join(f"\\x{{{x}}}" for x in p.split("-")) for p in parts)


def _among(parts: list[str]) -> str:
    return f"[\\x{{800}}-\\x{{3FFFF}}&&[{_ranges(parts)}]]"


def java_pattern(pattern: str, newer: bool = True) -> str:
    """``pattern`` with its classes of letters, numbers and white space as the JVM must name them; without ``newer``, for texts that have none of NEWER."""
    one = lambda known, parts: f"[{known}{_among(parts)}]" if newer else known
    # Alternatives of the pattern name the classes alone or in the one negated set.
    rest = f"[\\P{{IsWhite_Space}}&&\\P{{L}}&&\\P{{N}}&&[^{_ranges(LETTERS + NUMBERS)}]]" if newer else "[^\\p{IsWhite_Space}\\p{L}\\p{N}]"
    parts = pattern.split("[^\\s\\p{L}\\p{N}]")
    swap = lambda s: s.replace("\\p{L}", one("\\p{L}", LETTERS)).replace("\\p{N}", one("\\p{N}", NUMBERS)).replace("\\s", "\\p{IsWhite_Space}").replace("\\S", "\\P{IsWhite_Space}")
    return rest.join(map(swap, parts))


NEWER = _among(LETTERS + NUMBERS)


def pieces(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` in ``text``, in order."""
    cut = lambda newer: F.regexp_extract_all(text, F.lit(java_pattern(pattern, newer)), F.lit(0))
    return F.when(text.rlike(NEWER), cut(True)).otherwise(cut(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _dealt(entries: dict[str, str], fill: int = 2) -> tuple[Column, int]:
    """A literal array of maps and its size; a key lies in the map of its hash."""
    n = max(1, len(entries) // fill)
    maps: list[dict] = [{} for _ in range(n)]
    for key, value in entries.items():
        maps[xxhash.xxh64_intdigest(key.encode(), seed=42) % 2**63 % n][key] = value
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>"), n


def _look(maps: Column, n: int, key: Column) -> Column:
    place = F.xxhash64(key).bitwiseAND(F.lit(2**63 - 1)) % F.lit(n)
    return F.try_element_at(maps[place], key)


class ByteBpe:
    """The ranks of a vocabulary file and the column expressions made of them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        merges = {t.decode("latin-1"): chr(BASE + r) + "".join(chr(BASE + self.ranks[x]) for x in self._parts(t)) for t, r in self.ranks.items() if len(t) > 1}
        at: dict[str, list[str]] = {}
        for token, merge in merges.items():
            for k in range(2, min(len(token), DEPTH) + 1):
                at.setdefault(token[:k], [])
            if len(token) > DEPTH:
                at[token[:DEPTH]].append(merge)
        for head, found in at.items():
            found += [merges[head[:k]] for k in range(2, len(head) + 1) if head[:k] in merges]
        self.merges, self.n_merges = _dealt({k: "".join(v) for k, v in at.items()})
        self.bytes, self.ids = ("".join(map(chr, range(256))), "".join(chr(BASE + self.ranks[bytes([b])]) for b in range(256)))
        codes = [""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            codes[r] = f" {r}{ID_END}{t.decode('latin-1')}{BYTES_END}"
        self.codes = F.from_json(F.lit(json.dumps(codes)), "array<string>")

    def _parts(self, token: bytes) -> list[bytes]:
        """The two tokens whose merge makes ``token``: its encoding by lower ranks alone."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, k = min((self.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= self.ranks[token]:
                raise ValueError(f"{token!r} is no merge of two tokens of lower rank")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fold(self, word: Column, merges: Column) -> Column:
        """Ids of a piece, each as one character."""

        def candidates(b: Column) -> Column:
            at = lambda i, k: _look(merges, self.n_merges, F.substring(b, i, F.lit(k)))

            def from_place(i: Column) -> Column:
                """Merges found at the longest known head."""
                return F.coalesce(*(at(i, k) for k in range(DEPTH, 1, -1)), F.lit(""))

            # One byte has no pair; the sequence is then empty.
            places = F.when(F.length(b) > 1, F.sequence(F.lit(1), F.length(b) - 1)).otherwise(F.array().cast("array<int>"))
            return F.sort_array(F.array_distinct(F.regexp_extract_all(F.array_join(F.transform(places, from_place), ""), F.lit("(?s)..."), F.lit(0))))

        def run(b: Column) -> Column:
            return F.aggregate(candidates(b), F.translate(b, self.bytes, self.ids), lambda s, m: F.replace(s, F.substring(m, 2, 2), F.substring(m, 1, 1)))

        return _let(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), run)

    @staticmethod
    def coded(ids: Column, codes: Column) -> Column:
        """The codes of ids as ``fold`` gives them, in one string."""
        return F.array_join(F.transform(F.split(ids, ""), lambda c: codes[F.ascii(c) - BASE]), "")


def common_words(words: DataFrame, n: int = COMMON_WORDS) -> DataFrame:
    """``word`` of the ``n`` words that occur most often, of those that occur twice."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), "word").limit(n).select("word").repartition(12, "word")


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, text, decoded``: its ids in decimal, joined by blanks, and the bytes of these ids."""
    bpe = ByteBpe(ranks)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    words = source.sample(share, seed=1).select(F.explode(pieces(F.col("text"), pattern)).alias("word"))
    code = lambda word, m, codes: bpe.coded(bpe.fold(word, m), codes)
    own = _let(bpe.merges, lambda m: _let(bpe.codes, lambda codes: code(F.col("word"), m, codes)))
    ready = common_words(words).select("word", own.alias("c")).toArrow()
    common, n = _dealt(dict(zip(*(x.to_pylist() for x in ready.columns))))
    # The literals are bound once for a row, each by its own name: a field of a struct would be read again at each use.
    every = lambda known, m, codes: F.transform(pieces(F.col("text"), pattern), lambda w: F.coalesce(_look(known, n, w), code(w, m, codes)))
    found = _let(common, lambda known: _let(bpe.merges, lambda m: _let(bpe.codes, lambda codes: F.array_join(every(known, m, codes), ""))))
    ids = F.substring(F.regexp_replace("c", f"{ID_END}[^{BYTES_END}]*+{BYTES_END}", ""), 2, 2**31 - 1)
    decoded = F.encode(F.regexp_replace("c", f" [0-9]++{ID_END}|{BYTES_END}", ""), "ISO-8859-1")
    return source.select("doc_id", found.alias("c")).select("doc_id", ids.alias("text"), decoded.alias("decoded"))


def code_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``with_ids`` also ``ids array<int>, decoded binary``."""
    coded = encoded(docs, ranks, pattern, id_col, text_col)
    n = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
    more = [F.when(F.col("text") == "", F.array().cast("array<int>")).otherwise(F.split("text", " ").cast("array<int>")).alias("ids"), "decoded"] if with_ids else []
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2(F.encode("text", "utf-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
