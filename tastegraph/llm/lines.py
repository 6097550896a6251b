"""Fuzzy line dedup in DataFrame operations only.

Each line (trimmed, lower-cased) has a set of character shingles. Corpora are deduplicated
by ``stretches``: every stretch of SHINGLE characters of the line, at every position.
``word_shingles``, the default of the functions here, is a sample for where speed matters
more: the SHINGLE characters that begin at each word and at each piece of a longer run without
blanks. Such a run is cut after every character that is no Latin, Cyrillic or Greek letter or
digit, after some letters and digits, and after SHINGLE characters at the latest. A MinHash
signature is the run of the smallest shingle hashes; bands are three adjacent values of that
run, and in lines of few shingles also two, so two lines meet when they share neighbouring
minima. With ``stretches`` those that begin with a letter of FIRST count as smaller than all others,
so where a line has enough of them, the others, none of which can be among its minima, need no hash
there; where it has not, all are hashed. Lines that meet are compared by the exact Jaccard similarity of
their shingle sets, links become components by distributed union-find, and one line of a
component, the first by (doc_id, position), is kept. Exact repeats are the same line.

Any two lines of a band are compared unless other links already join them. First, a line
meets the band's first line and the LAGS lines before it, which is every pair of a band of
up to LAGS + 2 lines. In a larger band whose lines then lie in several components, the lines
are cut into chunks: a component of many lines has chunks of its own, the lines of small ones
are dealt together. Each pair of chunks, but for those of one component, is one row, in which
the lines of different components are compared, and only links between components leave it.
So the components are those of all similar pairs that share a band, and no band is ever
gathered or expanded into its pairs.

The lines of all documents are split and hashed once, into a table of places and bands; those
that are compared are read again, once for each distinct line. Maps of a few bits, one parity for
each class of hashes, tell most unlike lines apart: maps differ in no more bits than sets do in
shingles. The others are joined as text, which is shorter than their sets, and hashed anew.
Tables of up to SMALL rows of a few numbers are broadcast to the joins that need them; larger
ones are joined by a shuffle, with the same result.

A line is told from others by two 64-bit hashes; the second keeps a line whose first hash an
unlike line happens to share.

Blank lines and lines under MIN_CHARS characters are always kept. A null text stays null,
an empty one empty; a document whose lines are all repeats stays with an empty text.
Identical rows count as one document and keep the same lines. An empty table gives an empty
result. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.plans.components import connected_components
from tastegraph.plans.scratch import materialize

SHINGLE = 12
SIMILARITY = 0.8
BANDS, FEW = 6, 5
LAGS = 3
#: Lines in a chunk of a large band, on average.
CHUNK = 64
MIN_CHARS = 16
#: Numbers of 64 bits in the map of a set, in the wide one of a large set, and what is large.
MAP, WIDE, LARGE = 4, 16, 400
#: Rows of a few numbers each that a join may broadcast.
SMALL = 500_000


def normalized(line: Column) -> Column:
    """What is compared of a line."""
    return F.lower(F.trim(line))


#: A blank-free run is passed up to its blank, or, if more than SHINGLE characters of it are left, up to a cut.
_CUT = r"[[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}0-9 ]048cgkoswаеиоεικο]"
_PIECE = f"(?:[^ ]{{0,{SHINGLE}}}+ |(?=[^ ]{{{SHINGLE + 1}}})(?:[^ ]{{0,{SHINGLE - 1}}}?{_CUT}|[^ ]{{{SHINGLE}}}))"


def word_shingles(line: str) -> str:
    """SQL of 32-bit hashes of the shingles at the words and cuts of the normalized ``line``."""
    return f"transform(regexp_extract_all(concat(' ', {line}), r'(?s){_PIECE}(?=(.{{1,{SHINGLE}}}+))', 1), x -> hash(x))"


def stretches(line: str) -> str:
    """SQL of 32-bit hashes of every stretch of SHINGLE characters of ``line``; a shorter line is one stretch."""
    return rf"transform(regexp_extract_all({line}, r'(?s)(?=(.{{{SHINGLE}}}|\A.{{1,{SHINGLE - 1}}}\z)).', 1), x -> hash(x))"


#: Stretches that begin with one of these letters come before the others in the order of hashes.
FIRST = "cgkosw"


def first_stretches(line: str) -> str:
    """SQL of the hashes of the ``stretches`` of ``line`` of full width that begin with a letter of FIRST."""
    return rf"transform(regexp_extract_all({line}, r'(?s)[{FIRST}](?<=(?=(.{{{SHINGLE}}})).)', 1), x -> hash(x))"


Shingles = Callable[[str], str]


def shingle_hashes(line: str, shingles: Shingles = word_shingles) -> Column:
    """Distinct hashes, in order, of the shingles of the normalized line in column ``line``."""
    return F.expr(f"sort_array(array_distinct({shingles(line)}))")


def _occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, dk, pos, n, lid, check`` of every line that takes part; dk tells documents of one id apart."""
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = base.select("doc_id", "dk", "pos", normalized(F.col("line")).alias("n"))
    return lines.where(F.length("n") >= MIN_CHARS).withColumns({"lid": F.xxhash64("n"), "check": F.xxhash64(F.lit(1), "n")})


def bands_of(hashes: str) -> Column:
    """Keys of the runs of minima in the ordered array ``hashes``; a set of up to FEW hashes has runs of two besides those of three."""
    threes = f"transform(sequence(1, greatest(1, least({BANDS}, size({hashes}) - 2))), i -> xxhash64(get({hashes}, i - 1), get({hashes}, i), get({hashes}, i + 1)))"
    twos = f"transform(sequence(1, greatest(1, size({hashes}) - 1)), i -> xxhash64(get({hashes}, i - 1), get({hashes}, i)))"
    return F.expr(f"if(size({hashes}) <= {FEW}, array_union({threes}, {twos}), {threes})")


def with_minima(lines: DataFrame, shingles: Shingles = word_shingles) -> DataFrame:
    """``lines`` with the array ``s`` of the distinct hashes of ``n`` in their order, at least as many as the bands need."""
    if shingles is not stretches:
        return lines.withColumn("s", shingle_hashes("n", shingles))
    first = lines.withColumn("_first", shingle_hashes("n", first_stretches))
    enough = max(BANDS + 2, FEW + 1)
    return first.withColumn("s", F.when(F.size("_first") >= enough, F.slice("_first", 1, enough)).otherwise(F.array_union("_first", shingle_hashes("n", stretches)))).drop("_first")


def _with_bands(occurrences: DataFrame, shingles: Shingles) -> DataFrame:
    return occurrences if "bands" in occurrences.columns else with_minima(occurrences, shingles).withColumn("bands", bands_of("s")).drop("s", "n")


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= SMALL else table


def distinct_lines(occurrences: DataFrame, shingles: Shingles = word_shingles) -> DataFrame:
    """``lid, check, first (doc_id, dk, pos), times, bands`` for each distinct line."""
    rows = _with_bands(occurrences, shingles).select("lid", "check", F.struct("doc_id", "dk", "pos").alias("at"), "bands")
    return rows.groupBy("lid", "check").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"), F.any_value("bands").alias("bands"))


def _posted(lines: DataFrame) -> DataFrame:
    return lines.select("lid", F.explode("bands").alias("band"))


def shared_bands(lines: DataFrame) -> DataFrame:
    """``band, least, most, n`` of each band of several lines."""
    sized = _posted(lines).groupBy("band").agg(F.min("lid").alias("least"), F.max("lid").alias("most"), F.count(F.lit(1)).alias("n"))
    return sized.where("n > 1")


def large_bands(lines: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """``band, least, chunks`` of each band of more than LAGS + 2 lines."""
    shared = shared_bands(lines) if shared is None else shared
    return shared.where(F.col("n") > LAGS + 2).select("band", "least", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))


def candidate_pairs(lines: DataFrame, large: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Distinct ``(a, b)`` line ids of first comparisons: all pairs of small bands, a sparse net over the ``large`` ones."""
    shared = shared_bands(lines) if shared is None else shared
    twos = shared.where("n = 2").select(F.col("most").alias("a"), F.col("least").alias("b"))
    more = materialize(shared.where("n > 2").select("band").join(large, "band", "left"), "bands")
    chunk = F.coalesce(F.pmod(F.xxhash64("lid", "band"), F.col("chunks")).cast("int"), F.lit(0))
    order = W.partitionBy("band", "chunk").orderBy("lid")
    near = [F.coalesce("least", F.first("lid").over(order)), *(F.lag("lid", k).over(order) for k in range(1, LAGS + 1))]
    met = _posted(lines).join(_small(more), "band").withColumn("chunk", chunk).select("lid", F.array(*near).alias("others"))
    pairs = met.select("lid", F.explode("others").alias("b")).where("b is not null and b <> lid")
    return twos.union(pairs).distinct()


def mapped(lines: DataFrame, shingles: Shingles = word_shingles) -> DataFrame:
    """``lines`` (lid, n) with the size ``k`` of the set, its map ``m``, and of a LARGE set the wide map ``w``; a bit is the parity of the shingles in its class."""
    number = "aggregate(filter(s, x -> (shiftright(x, 6) & {}) = {}), 0L, (m, x) -> m ^ shiftleft(1L, x & 63))"
    numbers = lambda n: f"array({', '.join(number.format(n - 1, i) for i in range(n))})"
    found = f"transform(array(array_distinct({shingles('n')})), s -> struct(size(s) as k, {numbers(MAP)} as m, if(size(s) > {LARGE}, {numbers(WIDE)}, null) as w))[0]"
    return lines.select("lid", "n", F.expr(found).alias("f")).select("lid", "n", "f.*")


def _may_be_alike(p: str, q: str, similarity: float) -> str:
    """Whether the sets of ``p`` and ``q`` (prefixes of k, m, w) may have the ``similarity``, by sizes and maps."""
    bound = f"{1 - similarity} * ({p}k + {q}k) + 1e-9"
    differ = lambda x, n: " + ".join(f"bit_count({p}{x}[{i}] ^ {q}{x}[{i}])" for i in range(n))
    wide = f"{p}w is null or {q}w is null or ({differ('w', WIDE)}) * {1 + similarity} <= {bound}"
    return f"{p}k >= {similarity} * {q}k and {q}k >= {similarity} * {p}k and ({differ('m', MAP)}) * {1 + similarity} <= {bound} and ({wide})"


def _alike(p: str, q: str, similarity: float, shingles: Shingles) -> str:
    """Whether the sets of ``p`` and ``q`` (prefixes of n and k) have at least the Jaccard ``similarity``."""
    common = f"size(array_intersect({shingles(p + 'n')}, {shingles(q + 'n')}))"
    return f"{common} * {1 + similarity} >= {similarity} * ({p}k + {q}k) - 1e-9"


def line_links(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, shingles: Shingles = word_shingles) -> DataFrame:
    """``(a, b)`` of the ``pairs`` whose shingle sets have at least the Jaccard ``similarity``; ``sets`` is a written table as ``mapped`` gives it."""
    side = lambda c, *names: sets.select(F.col("lid").alias(c), *[F.col(x).alias(c + x) for x in names])
    met = pairs.join(_small(side("a", "k", "m", "w")), "a").join(_small(side("b", "k", "m", "w")), "b")
    near = materialize(met.where(_may_be_alike("a", "b", similarity)).select("a", "b"), "line-pairs")
    return near.join(side("a", "n", "k"), "a").join(side("b", "n", "k"), "b").where(_alike("a", "b", similarity, shingles)).select("a", "b")


def _chunked(members: DataFrame) -> DataFrame:
    """``band, lid, c, own, chunk`` of the members of bands with several components; ``own`` is the component that has the chunk to itself."""
    per = members.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m"))
    open_ = per.groupBy("band").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("m") < CHUNK, F.col("m")).otherwise(0)).alias("few")).where("kinds > 1")
    rows = members.join(per, ["band", "c"]).join(open_, "band")
    own = F.when(F.col("m") >= CHUNK, F.col("c"))
    part = F.when(F.col("m") >= CHUNK, F.pmod(F.xxhash64("lid"), F.ceil(F.col("m") / CHUNK))).otherwise(F.pmod(F.xxhash64("c"), F.greatest(F.lit(1), F.ceil(F.col("few") / CHUNK))))
    return rows.select("band", "lid", "c", own.alias("own"), part.alias("chunk"))


def component_links(lines: DataFrame, large: DataFrame, components: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, shingles: Shingles = word_shingles) -> DataFrame:
    """Distinct ``(a, b)`` components that similar lines of a large band join."""
    known = components.select(F.col("node").alias("lid"), "component")
    members = _posted(lines).join(_small(large.select("band")), "band").join(_small(known), "lid", "left").select("band", "lid", F.coalesce("component", "lid").alias("c"))
    rows = materialize(_chunked(materialize(members, "band-members")), "band-chunks")
    # Chunks are numbered within their band, those of one component next to each other.
    place = W.partitionBy("band").orderBy(F.asc_nulls_last("own"), "chunk")
    every = W.partitionBy("band")
    numbers = rows.select("band", "own", "chunk").distinct().select("band", "own", "chunk", F.row_number().over(place).alias("k"), F.count(F.lit(1)).over(every).alias("last"))
    numbers = numbers.withColumn("begin", F.when(F.col("own").isNull(), F.col("k")).otherwise(F.max("k").over(W.partitionBy("band", "own")) + 1))
    packed = rows.join(sets, "lid").groupBy("band", "own", "chunk").agg(F.collect_list(F.struct("c", "k", "m", "w", "n")).alias("x"))
    same = packed["band"].eqNullSafe(numbers["band"]) & packed["own"].eqNullSafe(numbers["own"]) & packed["chunk"].eqNullSafe(numbers["chunk"])
    placed = materialize(packed.join(numbers, same).select(packed["band"], "k", "begin", "last", "x"), "band-chunks")
    left = placed.where("begin <= last").select("band", F.explode(F.sequence("begin", "last")).alias("k"), F.col("x").alias("y"))
    met = left.join(placed.select("band", "k", "x"), ["band", "k"])
    alike = f"{_may_be_alike('p.', 'q.', similarity)} and {_alike('p.', 'q.', similarity, shingles)}"
    links = F.expr(f"flatten(transform(x, p -> transform(filter(y, q -> p.c <> q.c and {alike}), q -> struct(least(p.c, q.c) as a, greatest(p.c, q.c) as b))))")
    return met.select(F.explode(F.array_distinct(links)).alias("l")).select("l.a", "l.b").distinct()


def line_components(occurrences: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, shingles: Shingles = word_shingles) -> DataFrame:
    """``(node, component)`` of every line id with a similar line; ``occurrences`` has the lines ``n``."""
    shared = materialize(shared_bands(lines), "shared-bands")
    large = materialize(large_bands(lines, shared), "large-bands")
    pairs = materialize(candidate_pairs(lines, large, shared), "line-pairs")
    wanted = materialize(pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct(), "compared")
    found = occurrences.select("lid", "n").join(_small(wanted), "lid").groupBy("lid").agg(F.any_value("n").alias("n"))
    sets = materialize(mapped(found, shingles), "line-shingles")
    first = materialize(connected_components(line_links(pairs, sets, similarity, shingles)), "line-components")
    more = connected_components(component_links(lines, large, first, sets, similarity, shingles))
    more = materialize(more.select(F.col("node").alias("old"), F.col("component").alias("new")), "line-components")
    # A line that had no link before is its own old component.
    alone = more.join(first, more["old"] == first["component"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    joined = first.join(more, first["component"] == more["old"], "left")
    return joined.select("node", F.coalesce("new", "component").alias("component")).unionByName(alone)


def repeated_lines(occurrences: DataFrame, places: DataFrame, similarity: float = SIMILARITY, shingles: Shingles = word_shingles) -> DataFrame:
    """``lid, check, keep`` for each line that stands more than once; ``keep`` is the place (doc_id, dk, pos) that stays. ``places`` are the ``occurrences`` with bands."""
    lines = materialize(distinct_lines(places), "lines")
    components = materialize(line_components(occurrences, lines, similarity, shingles), "line-components")
    member = F.broadcast(components) if components.count() <= SMALL else components
    placed = lines.select("lid", "check", "first", "times").join(member, F.col("lid") == F.col("node"), "left").where("component is not null or times > 1")
    placed = materialize(placed.drop("node"), "repeated-lines")
    least = placed.where("component is not null").groupBy("component").agg(F.min("first").alias("keep"))
    return placed.join(least, "component", "left").select("lid", "check", F.coalesce("keep", "first").alias("keep"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, shingles: Shingles = word_shingles) -> DataFrame:
    """``docs`` with the text of each document less its repeated lines; all rows and columns stay."""
    names = docs.columns
    places = materialize(_with_bands(_occurrences(docs), shingles), "line-places")
    rules = materialize(repeated_lines(_occurrences(docs), places, similarity, shingles), "line-rules")
    seen = places.select("doc_id", "dk", "pos", "lid", "check").join(_small(rules), ["lid", "check"])
    dropped = seen.where(~F.struct("doc_id", "dk", "pos").eqNullSafe(F.col("keep"))).select("doc_id", "dk", "pos").distinct()
    drops = dropped.groupBy("doc_id", "dk").agg(F.sort_array(F.collect_list("pos")).alias("drops"))
    drops = materialize(drops.select(F.col("doc_id").alias("_d_id"), F.col("dk").alias("_d_key"), "drops"), "line-drops")
    size = drops.agg((F.count(F.lit(1)) + F.coalesce(F.sum(F.size("drops")), F.lit(0)) / 8).alias("n")).first()["n"]
    drops = F.broadcast(drops) if size <= SMALL else drops
    packed = docs.select(F.struct(*names).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    joined = packed.join(drops, (F.col("_key") == F.col("_d_key")) & F.col("doc_id").eqNullSafe(F.col("_d_id")), "left")
    split = joined.select("row", "text", "drops", F.when(F.col("drops").isNotNull(), F.split("text", "\n")).alias("lines"))
    # The runs of lines between dropped positions, in one pass over the lines.
    runs = "zip_with(concat(array(0), transform(drops, x -> x + 1)), concat(drops, array(size(lines))), (s, e) -> slice(lines, s + 1, e - s))"
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.expr(runs)), "\n"))
    return split.select("row", text.alias("_text")).select(
        *[F.col("_text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    )
