"""Title search: substring ranking in SQL functions, fuzzy prefixes per distinct word."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.functions.scores import letter, tokens

#: Edits that the longest query words may have, and characters of pairs that are compared together.
MOST_EDITS, CELLS = 2, 1 << 20


def words_of(titles: DataFrame) -> DataFrame:
    """``item_id, title_id, word, at`` of every word of every title."""
    return titles.select("item_id", "title_id", F.posexplode(tokens(F.col("title"))).alias("at", "word"))


def query_words(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.posexplode(tokens(F.col("query"))).alias("q_at", "q"))


def _suffix_starts(word: Column) -> Column:
    n = F.length(word)
    p = F.when(n > 10, F.floor(n / 2) + 2).when(n > 5, n - 3).otherwise(n - 2).cast("int")
    return F.sequence(F.lit(0), F.greatest(F.lit(1), p) - 1)


def _best_titles(found: DataFrame, titles: DataFrame, ranks: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The best title of each item, then the best ``limit`` items of each query."""
    full = found.join(titles.select("item_id", "title_id", "title"), ["item_id", "title_id"]).join(ranks.select("item_id", "rank"), "item_id", "left")
    order = [*order, F.coalesce("rank", F.lit(2**31 - 1)), F.col("item_id"), F.desc("title_id")]
    one = full.withColumn("k", F.row_number().over(W.partitionBy("query", "item_id").orderBy(*order))).where("k = 1")
    return one.withColumn("rk", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rk") <= limit).select("query", "rk", "item_id", "title")


def substring_suggest(titles: DataFrame, ranks: DataFrame, queries: DataFrame, limit: int = 15) -> DataFrame:
    """Titles with words that hold the query's words, early places and short rests first."""
    suffix = words_of(titles).select("item_id", "title_id", "word", F.explode(_suffix_starts(F.col("word"))).alias("start"))
    suffix = suffix.withColumn("tail", F.expr("substring(word, start + 1)"))
    q = query_words(queries).distinct()
    rest = F.length("word") - F.length("q")
    rank = F.when(F.col("start") == 0, rest).otherwise(F.col("start") * 2 - F.floor(F.length("q") / 3) + rest * 3)
    # The first character is an equality that every match shares, so the join is hashed on it.
    hit = suffix.join(q, (F.substring("tail", 1, 1) == F.substring("q", 1, 1)) & F.col("tail").startswith(F.col("q")))
    word = hit.groupBy("query", "q_at", "item_id", "title_id").agg(F.min(rank).alias("r"))
    total = word.groupBy("query", "item_id", "title_id").agg(F.count(F.lit(1)).alias("matches"), F.sum("r").alias("r"))
    return _best_titles(total, titles, ranks, [F.desc("matches"), F.col("r")], limit)


def edit_budget(length: int) -> int:
    """Edits allowed to a query word of so many characters."""
    return 0 if length <= 2 else 1 if length <= 5 else 2


def edit_state(q: str, word: str) -> tuple[int, int, int] | None:
    """(skipped, edits, rest of the word) of the best way to read all of ``q`` at the head of ``word``.

    Skipped is by how much the characters read of the two differ in number; the fewest skipped,
    then the fewest edits, then the shortest rest are best. The last character of ``q`` must match as it is.
    """
    budget = edit_budget(len(q))
    states, best = {(0, 0): 0}, None
    while states:
        (i, j), cost = states.popitem()
        if i == len(q):
            found = (abs(j - i), cost, len(word) - j)
            if best is None or found < best:
                best = found
            continue
        steps = []
        if j < len(word):
            if q[i] == word[j]:
                steps.append((i + 1, j + 1, cost))
            steps.append((i, j + 1, cost + 1))
            if i + 1 < len(q):
                steps.append((i + 1, j + 1, cost + 1))
        if i + 1 < len(q):
            steps.append((i + 1, j, cost + 1))
        for a, b, c in steps:
            if c <= budget and c < states.get((a, b), budget + 1):
                states[(a, b)] = c
    return best


def edit_match(q: str, word: str) -> tuple[int, int] | None:
    """(edits, rest of the word) of the best reading."""
    found = edit_state(q, word)
    return found and found[1:]


def query_keys(q: str) -> list[tuple[str, int]]:
    """(characters, place) pairs of which every word that ``q`` matches has one.

    With k edits at least one of k + 1 pieces of the query is untouched, and stands in the word at
    most k characters from its place; the first two characters of each piece are its key.
    """
    k = edit_budget(len(q))
    cut = [round(len(q) * n / (k + 1)) for n in range(k + 2)]
    return sorted({(q[s:e][:2], at) for s, e in zip(cut, cut[1:]) for at in range(max(0, s - k), s + k + 1)})


def word_keys(word: Column) -> Column:
    """(characters, place) of every one and two neighbouring characters of a word."""
    at = F.sequence(F.lit(0), F.length(word) - 1)
    of = lambda n: F.transform(at, lambda i: F.struct(F.substring(word, i + 1, F.lit(n)).alias("part"), i.alias("place")))
    return F.array_distinct(F.concat(of(1), of(2)))


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all words end to end, where each begins, their numbers)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def _heads(flat: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` characters of each word, filled up with a number that is no character."""
    at = np.arange(width)
    held = at < size[:, None]
    out = np.full((len(first), width), 0xFFFFFFFF, np.uint32)
    out[held] = flat[(first[:, None] + at)[held]]
    return out


def _banded(q: np.ndarray, word: np.ndarray, n_word: np.ndarray, n: int) -> np.ndarray:
    """(skipped, edits, rest), or -1, of pairs with queries of ``n`` characters, by one dynamic programme.

    ``cost[d]`` is the least cost of having read i characters of the query and i + d - MOST_EDITS
    of the word; reading numbers that differ by more costs more than any budget.
    """
    none, far = np.int64(2**62), np.int8(9)
    offsets = range(-MOST_EDITS, MOST_EDITS + 1)
    cost = np.stack([np.where((d >= 0) & (d <= n_word), np.int8(max(d, 0)), far) for d in offsets])
    key = n_word if n == 0 else np.full(len(n_word), none)
    for i in range(1, n + 1):
        fresh = np.full_like(cost, far)
        for d, off in enumerate(offsets):
            j = i + off
            if j < 0:
                continue
            inside = j <= n_word
            same = (q[:, i - 1] == word[:, j - 1]) & inside if j else np.zeros(len(n_word), bool)
            if i == n:  # the last character has to match
                state = ((4 * abs(off) + cost[d].astype(np.int64)) << 40) + n_word - j
                key = np.minimum(key, np.where(same & (cost[d] <= edit_budget(n)), state, none))
                continue
            steps = [cost[d] + ~same] if j else []
            steps += [cost[d + 1] + 1] if d + 1 < len(offsets) else []
            steps += [fresh[d - 1] + 1] if d and j else []
            fresh[d] = np.where(inside, np.minimum(np.minimum.reduce(steps), far), far)
        cost = fresh
    parts = np.stack([key >> 42, key >> 40 & 3, key & (1 << 40) - 1], 1)
    return np.where(key[:, None] < none, parts, -1)


def edit_states(q: list[str], word: list[str]) -> np.ndarray:
    """``edit_state`` of every pair of two lists, a row of three numbers each; -1 where there is none.

    Pairs of one query length are compared together, CELLS characters at a time; of a word no
    more is looked at than the query can reach.
    """
    out = np.full((len(q), 3), -1, np.int64)
    flat_q, first_q, n_q = _characters(q)
    flat_w, first_w, n_w = _characters(word)
    order = np.argsort(n_q, kind="stable")
    lengths, begin = np.unique(n_q[order], return_index=True)
    for n, rows in zip(lengths, np.split(order, begin[1:])):
        step = max(1, CELLS // (int(n) + MOST_EDITS))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            out[r] = _banded(_heads(flat_q, first_q[r], n_q[r], int(n)), _heads(flat_w, first_w[r], n_w[r], int(n) + MOST_EDITS), n_w[r], int(n))
    return out


def _edits(q: pd.Series, word: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(edit_states(q.tolist(), word.tolist()), columns=["skipped", "distance", "level"])


def near_words(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """``q, word, skipped, distance, level`` for each wanted ``q`` and ``word`` that begins like it; only words that share a key with it are compared."""
    keys = F.pandas_udf(lambda q: q.map(lambda x: [{"part": p, "place": k} for p, k in query_keys(x)]), "array<struct<part:string,place:int>>")
    left = wanted.select("q", F.explode(keys("q")).alias("key")).select("q", "key.part", "key.place")
    right = vocabulary.select("word", F.explode(word_keys(F.col("word"))).alias("key")).select("word", "key.part", "key.place")
    met = right.join(left, ["part", "place"]).select("q", "word").distinct()
    found = met.withColumn("m", F.pandas_udf(_edits, "struct<skipped:int,distance:int,level:int>")("q", "word"))
    return found.where("m.distance >= 0").select("q", "word", "m.skipped", "m.distance", "m.level")


def fuzzy_suggest(titles: DataFrame, ranks: DataFrame, queries: DataFrame, limit: int = 15) -> DataFrame:
    """Titles whose words begin like the query's words, up to two edits; each distinct word is compared once."""
    words = words_of(titles).select("item_id", "title_id", "word").distinct()
    q = query_words(queries)
    near = near_words(words.select("word").distinct(), q.select("q").distinct())
    best = F.min(F.struct("skipped", "distance", "level")).alias("b")
    word = near.join(q, "q").join(words, "word").groupBy("query", "q_at", "item_id", "title_id").agg(best)
    total = word.groupBy("query", "item_id", "title_id").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("b.skipped").alias("skipped"), F.sum("b.distance").alias("distance"), F.max("b.level").alias("level")
    )
    order = [F.desc("matches"), F.floor(F.col("distance") * 10 / F.col("matches")), F.col("skipped"), F.col("level")]
    return _best_titles(total, titles, ranks, order, limit)


def browse(items: DataFrame, examples: int = 4) -> DataFrame:
    """``letter, n, rk, item_id``: number of titles under each letter, and a seeded few of them."""
    rows = items.select(letter(F.col("title")).alias("letter"), "item_id")
    count = rows.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    shuffled = W.partitionBy("letter").orderBy(F.pmod(F.col("item_id") * 2654435761, F.lit(4294967296)), "item_id")
    return rows.withColumn("rk", F.row_number().over(shuffled)).where(F.col("rk") <= examples).join(count, "letter").select("letter", "n", "rk", "item_id")
