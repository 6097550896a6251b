"""Repair of conversations: the cheapest edits that give ``(system?(user assistant)+)?``.

A row is one of twelve symbols: role class (user, assistant, system, other) times what must be
done (nothing, mend a cut-off end, delete). A grammar is learned from all distinct sequences of
symbols, as Re-Pair does: the commonest adjacent pairs become rules, in rounds. Each rule has one
min-plus matrix over the states of the output (nothing yet, after system, after user, after
assistant), whose entries are a cost and the edits as a rope that shares the ropes of the rule's
parts. Matrices are multiplied bottom-up once for a rule, then once for a distinct sequence of
rules, whichever conversations have it.

Long conversations are cut into stretches of ``STRETCH`` rows by their place in a range-sorted
table, so a hot one has many tasks; only one matrix for each stretch meets in order. The repaired
text is hashed as it streams by in order. What one task holds of a conversation is its audit, a
letter for a row, which is one value of the result.

Of audits that cost the same the ASCII-least counts. Two with one cost, for the same rows, are never
prefixes of each other (what is over could only be inserts, which cost), so the least of
parts is the part of the least.

Nulls, ties: a null id, role or text counts as one space, and null ids are one conversation; rows of one turn
are ordered by role, then by a digest of role and text; repeated rows are one row and its
duplicates. Other columns, whatever their names, take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.plans.scratch import materialize

#: Rows of a stretch; rounds of the grammar, and pairs that become rules in one.
STRETCH, ROUNDS, RULES = 4096, 12, 64
#: Costs of edits.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ROLES, KINDS = "uaso", "ktx"  # user, assistant, system, other; keep, cut off, delete
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an output of each role, if it may follow.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Role that may be inserted or given in each state.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Inserts that end a conversation.
END = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def symbol(role: int, kind: int) -> str:
    return chr(ord("A") + 3 * role + kind)


def text_of(rope) -> str:
    """A rope's letters."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is not None:
            todo += [x[1], x[0]]
    return "".join(out)


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return min(a, b, key=lambda x: x[0])
    return a if a[1] is b[1] or text_of(a[1]) <= text_of(b[1]) else b


def row_matrix(role: int, kind: int) -> list:
    """Cheapest (cost, rope) of one row, with inserts before it, from each state to each; None where there is no way."""
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        state, cost, before = i, 0, ""
        for _ in range(3):  # more inserts than two only go round
            ways = [(state, DELETE, "D")]
            if KINDS[kind] != "x":
                more = CUT_OFF if KINDS[kind] == "t" else 0
                if (state, ROLES[role]) in AFTER:
                    ways.append((AFTER[state, ROLES[role]], more, "K"))
                ways.append((AFTER[state, NEXT[state]], REROLE + more, "R"))
            for j, own, letter in ways:
                out[i][j] = _better(out[i][j], (cost + own, before + letter))
            state, cost, before = AFTER[state, NEXT[state]], cost + INSERT, before + "I"
    return out


def times(a: list, b: list) -> list:
    """Min-plus product."""
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if a[i][k] is not None:
                for j in range(4):
                    if b[k][j] is not None:
                        out[i][j] = _better(out[i][j], (a[i][k][0] + b[k][j][0], (a[i][k][1], b[k][j][1])))
    return out


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(x: tuple, y: tuple) -> tuple:
    """(matrix, first role, last role, illegal pairs) of two stretches in a row."""
    return times(x[0], y[0]), x[1], y[2], x[3] + y[3] + (not _legal(x[2], y[1]))


def terminals() -> dict[str, tuple]:
    return {symbol(r, k): (row_matrix(r, k), ROLES[r], ROLES[r], 0) for r in range(4) for k in range(3)}


def grammar(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> tuple[DataFrame, dict[str, tuple]]:
    """(``seq, short``, value of each symbol): the sequences in symbols of rules.

    A round makes rules of the commonest pairs, no two of which share a symbol, and ends the search
    where no pair stands twice. Pairs are counted where they lie; the number of distinct ones
    is bounded by that of symbols.
    """
    value, made = terminals(), 0
    now = materialize(sequences.select("seq", F.col("seq").alias("short")), "grammar")
    for _ in range(rounds):
        pairs = now.select(F.explode(F.regexp_extract_all("short", F.lit("(?s)(?=(..))"), F.lit(1))).alias("pair")).groupBy("pair").count().where("count > 1")
        used, chosen = set(), []
        for r in pairs.orderBy(F.desc("count"), "pair").limit(16 * rules).collect():
            if not used & set(r["pair"]) and len(chosen) < rules:
                used |= set(r["pair"])
                chosen.append(r["pair"])
        if not chosen:
            break
        short = F.col("short")
        for pair in chosen:
            name = chr(0x4E00 + made)
            made += 1
            value[name] = joined(value[pair[0]], value[pair[1]])
            short = F.replace(short, F.lit(pair), F.lit(name))
        now = materialize(now.select("seq", short.alias("short")), "grammar")
    return now, value


def solved(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """``seq, costs array<long>, audits array<string>, first, last, illegal``: the matrix of each distinct sequence, row by row."""
    short, value = grammar(sequences, rounds, rules)
    shared = sequences.sparkSession.sparkContext.broadcast(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq, symbols in zip(batch["seq"].to_pylist(), batch["short"].to_pylist()):
                total = shared.value[symbols[0]]
                for s in symbols[1:]:
                    total = joined(total, shared.value[s])
                flat = [e for line in total[0] for e in line]
                rows.append({"seq": seq, "costs": [-1 if e is None else e[0] for e in flat], "audits": ["" if e is None else text_of(e[1]) for e in flat], "first": total[1], "last": total[2], "illegal": total[3]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("seq", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]))

    return short.mapInArrow(run, "seq string, costs array<long>, audits array<string>, first string, last string, illegal long")


def _follow(entries: list, row: dict) -> list:
    """Best (cost, (earlier, piece)) at each state after one more stretch."""
    out: list = [None] * 4
    for i, e in enumerate(entries):
        if e is not None:
            for j in range(4):
                cost = row["costs"][4 * i + j]
                if cost >= 0:
                    new = (e[0] + cost, (e[1], row["audits"][4 * i + j]))
                    out[j] = new if out[j] is None or new[0] < out[j][0] or new[0] == out[j][0] and _earlier(new[1], out[j][1]) else out[j]
    return out


def _earlier(a: tuple | None, b: tuple | None) -> bool:
    """Whether the pieces of ``a`` come before those of ``b``; both have as many, and share their earliest."""
    x, y = [], []
    while a is not b:
        x.append(a[1])
        y.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(x)) < "".join(reversed(y))


def _coded(audit: str, stretches: list[dict]) -> Iterator[tuple[dict, list[int], list[str]]]:
    """(stretch, places, codes) of rows that stay: inserted initials before the row, then K, or R and the new initial."""
    state, at = START, 0
    for n, s in enumerate(stretches):
        places, codes = [], []
        for k, sym in enumerate(s["seq"]):
            code = ""
            while audit[at] == "I":
                code, state, at = code + NEXT[state], AFTER[state, NEXT[state]], at + 1
            letter, at = audit[at], at + 1
            if letter == "R":
                code, state = f"{code}R{NEXT[state]}", AFTER[state, NEXT[state]]
            elif letter == "K":
                code, state = f"{code}K", AFTER[state, ROLES[(ord(sym) - ord("A")) // 3]]
            if code:
                places.append(s["start"] + k)
                codes.append(code)
        if n == len(stretches) - 1 and at < len(audit):
            code = ""
            for _ in audit[at:]:
                code, state = code + NEXT[state], AFTER[state, NEXT[state]]
            places.append(s["start"] + len(s["seq"]))
            codes.append(code)
        yield s, places, codes


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, times``: rows after the damage that ``crc32(conv_id:turn) % 20`` deals; dropped ones are gone."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = rows.withColumn("_d", F.crc32(name.cast("binary")) % 20).where("_d <> 0")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return hit.select(
        "conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("times"),
    )


def _with(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null, with one copy of them."""
    renamed = b.withColumnsRenamed({c: f"_{c}" for c in columns})
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(renamed, on, how).drop(*[f"_{c}" for c in columns])


def repaired(rows: DataFrame, stretch: int = STRETCH, rounds: int = ROUNDS, rules: int = RULES) -> tuple[DataFrame, DataFrame]:
    """(per conversation ``conv_id, blank, duplicate, truncated, illegal, cost, audit``, its lines ``conv_id, pid, at, line``).

    ``rows`` have ``conv_id, turn, role, text, times``; lines are those of the repaired conversation in the order of (pid, at).
    """
    of = rows.schema["conv_id"].dataType.simpleString()
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    light = keyed.select("conv_id", "turn", "role", "key", "times", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    light = light.groupBy("conv_id", "turn", "key").agg(F.sum("times").alias("times"), F.min("role").alias("role"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # Among equal rows of a conversation the one of the least turn is the first; a null turn is the least.
    when = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = light.groupBy("conv_id", "key").agg(F.min(when).alias("_first"))
    light = _with(light, first, ["conv_id", "key"]).withColumn("first", when.eqNullSafe(F.col("_first")))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    kind = F.when(F.col("blank") | ~F.col("first"), 2).when(F.col("cut"), 1).otherwise(0)
    letters = F.lit("".join(symbol(r, k) for r in range(4) for k in range(3)))
    run = F.concat(F.substring(letters, 3 * place + kind + 1, F.lit(1)), F.repeat(F.substring(letters, 3 * place + 3, F.lit(1)), (F.col("times") - 1).cast("int")))
    ready = light.select("conv_id", "turn", "role", "key", "blank", "cut", "first", "times", run.alias("run"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pid = 0, TaskContext.get().partitionId()
        for b in batches:
            ends = b["times"].to_numpy().cumsum() + at
            starts = ends - b["times"].to_numpy()
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * len(b), pa.int64()), pa.array(starts, pa.int64())], [*b.schema.names, "pid", "at"])

    order = ["conv_id", "turn", "role", "key"]
    sorted_rows = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema) + ", pid long, at long"
    table = materialize(sorted_rows.mapInArrow(placed, schema), "turns")

    parts = table.groupBy("conv_id", "pid", F.floor(F.col("at") / stretch).alias("part")).agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "run"))).alias("runs"))
    parts = materialize(parts.select("conv_id", "pid", "start", F.array_join(F.col("runs")["run"], "").alias("seq")), "stretches")
    matrices = solved(parts.select("seq").distinct(), rounds, rules)
    met = parts.join(matrices, "seq").repartition("conv_id").sortWithinPartitions("conv_id", "pid", "start")
    out_schema = f"conv_id {of}, cost long, audit string, illegal long, pid long, places array<long>, codes array<string>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(conv, entries: list, stretches: list[dict], illegal: int) -> Iterator[dict]:
            ends = [(e[0] + INSERT * len(END[j]), (e[1], END[j])) for j, e in enumerate(entries) if e is not None]
            best = ends[0]
            for e in ends[1:]:
                if e[0] < best[0] or e[0] == best[0] and _earlier(e[1], best[1]):
                    best = e
            pieces, link = [], best[1]
            while link is not None:
                pieces.append(link[1])
                link = link[0]
            audit = "".join(reversed(pieces))
            yield {"conv_id": conv, "cost": best[0], "audit": audit, "illegal": illegal}
            for s, places, codes in _coded(audit, stretches):
                if places:
                    yield {"conv_id": conv, "pid": s["pid"], "places": places, "codes": codes}

        conv, entries, stretches, illegal, last, open_ = None, [], [], 0, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not open_ or row["conv_id"] != conv:
                    if open_:
                        out += closed(conv, entries, stretches, illegal)
                    conv, entries, stretches, illegal, last, open_ = row["conv_id"], [(0, None), None, None, None], [], 0, None, True
                illegal += row["illegal"] + (last is not None and not _legal(last, row["first"]))
                entries, last = _follow(entries, row), row["last"]
                stretches.append({"pid": row["pid"], "start": row["start"], "seq": row["seq"]})
            if out:
                yield pa.RecordBatch.from_pylist(out, wanted)
        if open_:
            yield pa.RecordBatch.from_pylist(list(closed(conv, entries, stretches, illegal)), wanted)

    wanted = pa.schema([("conv_id", _arrow(rows, "conv_id")), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("pid", pa.int64()), ("places", pa.list_(pa.int64())), ("codes", pa.list_(pa.string()))])
    folded = materialize(met.mapInArrow(fold, out_schema), "audits")
    fault = F.when(F.col("blank"), F.col("times")).otherwise(0)
    again = F.when(~F.col("blank"), F.col("times") - F.col("first").cast("long")).otherwise(0)
    cut = F.when(~F.col("blank") & F.col("first") & F.col("cut"), 1).otherwise(0)
    counts = table.groupBy("conv_id").agg(F.sum(fault).alias("blank"), F.sum(again).alias("duplicate"), F.sum(cut).alias("truncated"))
    found = _with(counts, folded.where("cost is not null").select("conv_id", "cost", "audit", "illegal"), ["conv_id"])

    codes = folded.where("places is not null").select("conv_id", "pid", F.explode(F.arrays_zip("places", "codes")).alias("x")).select("conv_id", "pid", F.col("x.places").alias("at"), F.col("x.codes").alias("code"))
    # The place after a conversation's last row may be that of another one's first.
    edits = _with(codes, table.select("conv_id", "pid", "at", "turn", "key"), ["conv_id", "pid", "at"], "left")
    own = keyed.select("conv_id", "turn", "key", F.col("role").alias("own_role"), "text")
    # Inserts after the last row have no row of their own: no key, so no text is looked for.
    texts = _with(edits.where("key is not null"), own, ["conv_id", "turn", "key"]).unionByName(edits.where("key is null").select("*", F.lit(None).cast("string").alias("own_role"), F.lit(None).cast("string").alias("text")))
    roles = lambda c: F.when(c == "u", "user").otherwise("assistant")
    before = F.regexp_extract("code", "^[ua]*", 0)
    inserted = F.when(before == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(before, ""), lambda c: F.concat(roles(c), F.lit(":"))))
    line = F.when(F.col("code").endswith("K"), F.concat("own_role", F.lit(":"), "text")).when(F.col("code").contains("R"), F.concat(roles(F.right("code", F.lit(1))), F.lit(":"), "text"))
    lines = texts.select("conv_id", "pid", "at", F.array_join(F.array_compact(F.concat(inserted, F.array(line))), "\n").alias("line"))
    return found, lines


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def line_digests(lines: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of each conversation's lines joined by line ends, hashed as they stream by."""
    of = lines.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, digest, ids, found = None, None, None, [], []
        for batch in batches:
            for row_conv, pid, at, line in zip(*(batch[c].to_pylist() for c in ("conv_id", "pid", "at", "line"))):
                if digest is None or row_conv != conv:
                    if digest is not None:
                        ids.append(conv)
                        found.append(digest.hexdigest())
                    conv, seen, digest = row_conv, None, hashlib.sha256()
                if seen == (pid, at):  # a repeated row stands once here
                    continue
                digest.update((("" if seen is None else "\n") + line).encode())
                seen = (pid, at)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found)], ["conv_id", "repaired_sha256"])
                ids, found = [], []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    kind = _arrow(lines, "conv_id")
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "at").mapInArrow(run, f"conv_id {of}, repaired_sha256 string")


def repair_digests(conversations: DataFrame, stretch: int = STRETCH, rounds: int = ROUNDS, rules: int = RULES) -> DataFrame:
    """Every original ``conv_id`` with ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` after damage and repair."""
    source = conversations.select("conv_id", "turn", "role", "text")
    rows = damaged(source)
    found, lines = repaired(rows, stretch, rounds, rules)
    turns = rows.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    every = source.select("conv_id").distinct()
    out = _with(_with(_with(every, turns, ["conv_id"], "left"), found, ["conv_id"], "left"), line_digests(lines), ["conv_id"], "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
