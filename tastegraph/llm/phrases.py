"""Phrase collocations: counts of all phrases by multikey quicksort of suffix pointers.

Three passes over the texts. The first counts words; the second counts adjacent pairs of
frequent words under a hash; both leave a bit map of fixed size of what is frequent, in which a
collision only lets something pass that is infrequent. The third cuts a suffix of at most five
words at each place, as far as all of its pairs may be frequent, sends suffixes with the same
two leading words to the same group and there sorts pointers to them by three-way partitions,
word after word: the weight of an equal partition is the count of the phrase up to that word,
and a partition that weighs too little is left unsorted. Equal suffixes of a block of texts
leave it as one with a weight. A group of more than ``GROUP_ROWS`` suffixes is split by the
words that follow; its parts' counts are then added up before they are judged.

Words are numbered by a 64-bit hash of language and word; should two words of the corpus
share one, everything is done again under another seed. So counts are exact.

Nulls, blanks: a null text counts as empty, a null language as ``und``. Empty texts and pieces have
no words. Rows that repeat count each. Ties go to the more frequent phrase, then by the bytes of
the phrase. Other columns, whatever their names, take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.plans.scratch import materialize

LEAST, LONGEST, FIRST = 100, 5, 2000
#: Characters of texts and rows of suffixes that are worked on together.
BLOCK_CHARS, BLOCK_ROWS = 4 << 20, 2 << 20
#: Bits of the maps of frequent words and pairs (8 MB each).
MAP_BITS = 26
#: Suffixes that are sorted together at most, about, and that a group is meant to have.
GROUP_ROWS, ROUTE_ROWS = 2 << 20, 1 << 18


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of symbols."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the map has the low bits of ``h`` set."""
    at = (h & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts): texts of one language and about ``BLOCK_CHARS`` characters."""
    for batch in batches:
        size, first = np.cumsum(pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False)), 0
        while first < len(size):
            start = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, start + BLOCK_CHARS, "right")))
            part = batch.slice(first, last - first)
            for lang in pc.unique(part["lang"]).to_pylist():
                yield lang, part["text"].filter(pc.equal(part["lang"], lang))
            first = last


def _words(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(codes, words): the texts' words one after the other; code -1 ends a piece."""
    low = pc.ascii_lower(texts.cast(pa.large_string()))
    low = pc.replace_substring_regex(low, "[.,;:!?\\x0A-\\x0D]", " \n ")
    low = pc.binary_join_element_wise(pc.replace_substring(low, "\t", " "), pa.scalar("\n", pa.large_string()), pa.scalar(" ", pa.large_string()))
    coded = pc.split_pattern(low, " ").flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if "" in words:
        codes = codes[codes != words.index("")]
    return np.where(codes == words.index("\n"), -1, codes) if "\n" in words else codes, words


def _symbol(lang: str, word: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{len(lang)}:{lang}{word}".encode(), seed=seed) or 1


def _symbols(lang: str, texts: pa.Array, seed: int, frequent: np.ndarray) -> np.ndarray:
    """Symbols of frequent words in order; 0 where a piece ends or another word stands."""
    codes, words = _words(texts)
    table = np.array([_symbol(lang, w, seed) for w in words] + [0], np.uint64)
    table[:-1][~_has(frequent, table[:-1])] = 0
    return table[codes]


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, int]:
    """(``lang, word, sym, n``, seed): how often each word occurs, and its number, which no other word has."""
    for seed in range(100):

        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for lang, texts in _blocks(batches):
                codes, words = _words(texts)
                n = np.bincount(codes[codes >= 0], minlength=len(words))
                own = np.flatnonzero(n)
                sym = np.array([_symbol(lang, words[k], seed) for k in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([words[k] for k in own], pa.string()), pa.array(sym), pa.array(n[own])], ["lang", "word", "sym", "n"])

        counted = _source(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, sym long, n long").groupBy("lang", "word", "sym").agg(F.sum("n").alias("n"))
        words = materialize(counted, "words")
        if words.groupBy("sym").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def _bit_map(rows: DataFrame, column: str) -> np.ndarray:
    """The map of the low bits of ``column``: at most 2048 rows of 4 KB come to the driver."""
    at = F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    parts = rows.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for r in parts:
        out[(r["b"] - 1) * 4096 :][:4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _dealt(route: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> Iterator[tuple[int, bytes]]:
    """Rows by their route, those of each packed into bytes."""
    order = np.argsort(route, kind="stable")
    ends = np.flatnonzero(np.diff(route[order])) + 1
    for part in np.split(order, ends) if len(order) else []:
        yield int(route[part[0]]), pack(part)


def _sent(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.binary())], ["route", "rows"])


def _gathered(found: Iterator[np.ndarray], rows: int = BLOCK_ROWS) -> Iterator[np.ndarray]:
    """Arrays put together to about ``rows`` rows."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x)
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _power(n: float, least: int = 6, most: int = 20) -> int:
    return int(np.clip(np.ceil(np.log2(max(1.0, n))), least, most))


def frequent_pairs(source: DataFrame, seed: int, frequent: np.ndarray, n_words: int, least: int) -> DataFrame:
    """``pair, n``: hashes of adjacent words that occur ``least`` times or more, and how often.

    Of a hash 32 bits and its route tell pairs apart; a count is held at 255 for each block, so
    it is a lower bound beyond ``least`` (which may be up to 255).
    """
    shared, bits = source.sparkSession.sparkContext.broadcast(frequent), _power(n_words / ROUTE_ROWS)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for lang, texts in _blocks(batches):
            s = _symbols(lang, texts, seed, shared.value)
            at = np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))
            yield _mixed([s[at], s[at + 1]]) >> np.uint64(64 - 32 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in _gathered(pairs(batches)):
            h, n = np.unique(h, return_counts=True)
            low, n = h.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
            yield _sent(list(_dealt((h >> np.uint64(32)).astype(np.int64), lambda part: low[part].tobytes() + n[part].tobytes())))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        low, n = [], []
        for x in table["rows"]:
            raw = np.frombuffer(x.as_buffer(), np.uint8)
            low.append(raw[: len(raw) // 5 * 4].view(np.uint32))
            n.append(raw[len(raw) // 5 * 4 :])
        values, at = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(at, np.concatenate(n)).astype(np.int64)
        often = total >= least
        return pa.table({"pair": pa.array(values[often].astype(np.int64) | (key[0].as_py() << 32)), "n": pa.array(total[often])})

    return source.mapInArrow(send, "route long, rows binary").groupBy("route").applyInArrow(meet, "pair long, n long")


def quicksort(columns: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a row, number of words, count) of each prefix of two words or more whose rows weigh ``least`` or more.

    Three-way partitions by one word at a time; a word 0 ends a suffix.
    """
    found, open_parts = [], [(np.arange(len(weight)), 0)]
    while open_parts:
        part, depth = open_parts.pop()
        if depth == len(columns) or weight[part].sum() < least:
            continue
        key = columns[depth][part]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[min(len(key), 9) // 2]
        same = key == pivot
        equal = part[same]
        size = int(weight[equal].sum())
        if size >= least and pivot:
            if depth:
                found.append((int(equal[0]), depth + 1, size))
            open_parts.append((equal, depth + 1))
        if len(equal) < len(part):
            less = key < pivot
            open_parts += [(part[less], depth), (part[~(less | same)], depth)]
    return found


def _runs(columns: list[np.ndarray], weight: np.ndarray) -> list[tuple[int, int, int]]:
    """As ``quicksort`` with ``least`` 1: all prefixes, from the sorted rows."""
    order, found = np.lexsort(columns[::-1]), []
    new = np.zeros(len(order), bool)
    new[:1] = True
    for depth, c in enumerate(columns):
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
        if depth:
            first = np.flatnonzero(new)
            total = np.add.reduceat(weight[order], first)
            there = c[first] != 0
            found += [(int(r), depth + 1, int(n)) for r, n in zip(order[first[there]], total[there])]
    return found


def _suffixes(s: np.ndarray, pair_bits: int, often: np.ndarray, longest: int) -> np.ndarray:
    """Rows of ``longest`` symbols, 0 after a suffix's end; all of its pairs may be frequent."""
    go = np.zeros(len(s) + longest, bool)
    at = np.flatnonzero((s[:-1] != 0) & (s[1:] != 0))
    go[at] = _has(often, _mixed([s[at], s[at + 1]]) >> np.uint64(64 - 32 - pair_bits))
    at = np.flatnonzero(go)
    padded = np.concatenate([s, np.zeros(longest, np.uint64)])
    out = np.zeros((len(at), longest), np.uint64)
    out[:, 0], on = padded[at], np.ones(len(at), bool)
    for k in range(1, longest):
        on &= go[at + k - 1]
        out[:, k] = np.where(on, padded[at + k], 0)
    return out


def phrase_counts(docs: DataFrame, words: DataFrame, seed: int, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``phrase array<long>, a``: each phrase of two to ``longest`` words, as their numbers, that occurs ``least`` times or more."""
    spark, source = docs.sparkSession, _source(docs, text_col, lang_col)
    if not 0 < least <= 255:
        raise ValueError("least lies between 1 and 255")
    n_words = words.agg(F.sum("n")).first()[0] or 0
    frequent = _bit_map(words.where(F.col("n") >= least), "sym")
    pair_bits = _power(n_words / ROUTE_ROWS)
    pairs = materialize(frequent_pairs(source, seed, frequent, n_words, least), "pairs")
    shared, often = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(_bit_map(pairs, "pair"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    bits = _power(total / ROUTE_ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for lang, texts in _blocks(batches):
            yield _suffixes(_symbols(lang, texts, seed, shared.value), pair_bits, often.value, longest)

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, weights), neighbours under a hash that are equal being one."""
        for x in _gathered(rows(batches)):
            x = x[np.argsort(_mixed(list(x.T)))]
            first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(1))))
            yield x[first], np.diff(np.concatenate((first, [len(x)])))

    route_of = lambda x: (_mixed([x[:, 0], x[:, 1]]) >> np.uint64(64 - bits)).astype(np.int64)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in collapsed(batches):
            n = np.bincount(route_of(x), minlength=1 << bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["route", "n"])

    # Only where the mean leaves room for a group too large is the distribution asked for; few routes can be.
    split: dict[int, int] = {}
    if total > group_rows:
        large = source.mapInArrow(sizes, "route long, n long").groupBy("route").agg(F.sum("n").alias("n")).where(F.col("n") > group_rows)
        split = {r["route"]: -(-r["n"] // group_rows) for r in large.collect()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.ones(1 << bits, np.int64)
        for k, n in split.items():
            parts[k] = n
        for x, n in collapsed(batches):
            route = route_of(x)
            own = (_mixed(list(x.T[2:])) >> np.uint64(1)).astype(np.int64) % parts[route] if longest > 2 else 0
            length, n = (x != 0).sum(1).astype(np.uint8), n.astype(np.uint32)
            pack = lambda part: len(part).to_bytes(4, "little") + length[part].tobytes() + n[part].tobytes() + x[part][np.arange(longest) < length[part][:, None]].tobytes()
            yield _sent(list(_dealt(route << 32 | own, pack)))

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        lengths, weights, symbols = [], [], []
        for x in table["rows"]:
            raw = np.frombuffer(x.as_buffer(), np.uint8)
            m = int(raw[:4].view(np.uint32)[0])
            lengths.append(raw[4 : 4 + m])
            weights.append(np.frombuffer(raw[4 + m : 4 + 5 * m].tobytes(), np.uint32))
            symbols.append(np.frombuffer(raw[4 + 5 * m :].tobytes(), np.uint64))
        length = np.concatenate(lengths)
        x = np.zeros((len(length), longest), np.uint64)
        x[np.arange(longest) < length[:, None]] = np.concatenate(symbols)
        columns, weight = [np.ascontiguousarray(c) for c in x.T], np.concatenate(weights).astype(np.int64)
        found = _runs(columns, weight) if key[0].as_py() >> 32 in split else quicksort(columns, weight, least)
        phrase = pa.array([x[r, :k].view(np.int64) for r, k, _ in found], pa.list_(pa.int64()))
        return pa.table({"phrase": phrase, "a": pa.array([n for _, _, n in found], pa.int64())})

    counted = source.mapInArrow(send, "route long, rows binary").groupBy("route").applyInArrow(sort, "phrase array<long>, a long")
    if split:
        counted = counted.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return materialize(counted, "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases by their weakest cut."""
    words, seed = word_counts(docs, text_col, lang_col)
    counted = phrase_counts(docs, words, seed, text_col, lang_col, least, longest, group_rows)
    # Every part of a frequent phrase is frequent, so it is counted: as a word or as a phrase.
    parts = counted.select("phrase", "a").unionByName(words.where(F.col("n") >= least).select(F.array("sym").alias("phrase"), F.col("n").alias("a")))
    cuts = counted.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, F.size("phrase")).alias("right"))
    cuts = cuts.join(parts.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    lang_of = words.where(F.col("n") >= least).select("sym", "lang", "word")
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # A phrase that stands in a longer one of the same count stands in one that is longer by a word.
    longer = counted.where(F.size("phrase") > 2)
    inside = longer.select(F.slice("phrase", F.lit(1), F.size("phrase") - 1).alias("phrase"), "a").unionByName(longer.select(F.slice("phrase", F.lit(2), F.size("phrase")).alias("phrase"), "a"))
    kept = counted.join(inside, ["phrase", "a"], "left_anti")
    named = kept.select("phrase", F.posexplode("phrase").alias("at", "sym")).join(lang_of, "sym").groupBy("phrase").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = named.select("phrase", "lang", F.array_join(F.col("w")["word"], " ").alias("text")).join(n, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(named, "phrase").withColumns({"_over": F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), "_under": whole("l") * whole("r")}).withColumn("score", F.expr("_over div _under"))
    weakest = scored.groupBy("phrase", "lang", "text", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "text")
    best = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
