"""Readers and writers of rating lists: JSON, protobuf, request bodies, XML dumps and list pages."""

from __future__ import annotations

import gzip
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegraph.functions.scores import day_of, short_date

# Fixed values of the formats: names of fields, codes of types.
_USER = "user_id:long,user_name:string,user_watching:int,user_reading:int,user_completed:int,user_onhold:int,user_dropped:int,user_plantowatch:int,user_plantoread:int"
_SHARED = "series_title:string,series_type:int,series_status:int,series_start:string,series_end:string,series_image:string,my_score:int,my_status:int,my_last_updated:long"
XML_SCHEMA = f"myinfo struct<{_USER}>, anime array<struct<series_animedb_id:long,series_episodes:int,{_SHARED}>>, manga array<struct<series_mangadb_id:long,series_chapters:int,series_volumes:int,{_SHARED}>>"
TYPES = {"TV": 1, "OVA": 2, "Movie": 3, "Special": 4, "ONA": 5, "Music": 6, "Manga": 1, "Novel": 2, "One-shot": 3, "Doujinshi": 4, "Manhwa": 5, "Manhua": 6}
PAGE_PREFIX = {"anime": ("anime_id", "anime_title", "anime_media_type_string", "anime_airing_status", "anime_num_episodes", "anime_num_episodes"), "manga": ("manga_id", "manga_title", "manga_media_type_string", "manga_publishing_status", "manga_num_chapters", "manga_num_volumes")}


def write_lists(ratings: DataFrame) -> DataFrame:
    """``user_id, list``: JSON ``[[item, status, rating], ...]`` in item order, with the day as a fourth number where there is a column ``day``."""
    days = ["day"] if "day" in ratings.columns else []
    numbers = F.array(*[F.col(c).cast("long") for c in ["item_id", "status", "rating", *days]])
    rows = ratings.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "status", "rating", numbers.alias("e")))).alias("l"))
    return rows.select("user_id", F.to_json("l.e").alias("list"))


def _entries(entries: Column) -> Column:
    at = lambda e, k: F.get(e, F.lit(k))
    # The day stands for finished and dropped items only.
    typed = F.transform(entries, lambda e: F.struct(at(e, 0).alias("item_id"), at(e, 1).cast("int").alias("status"), at(e, 2).cast("int").alias("rating"), F.when(at(e, 1).isin(2, 4), F.coalesce(at(e, 3), F.lit(0))).otherwise(0).cast("int").alias("day")))
    return F.array_sort(typed)


def read_lists(lists: DataFrame) -> DataFrame:
    """``user_id, item_id, status, rating, day`` of JSON lists, those of a list in order of the item; broken lists give no rows."""
    return lists.select("user_id", F.explode(_entries(F.from_json("list", "array<array<bigint>>"))).alias("e")).select("user_id", "e.*")


def read_request(body: Column) -> Column:
    """Sorted entries of a request body ``{"animeList": [[item, status, rating], ...]}``."""
    return _entries(F.from_json(body, "animeList array<array<bigint>>").getField("animeList"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _take(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _packed(entries: list) -> bytes:
    """A repeated field 1 of messages with the numbers of an entry as fields 1 to 4, zeros left out, gzipped."""
    out = []
    for e in entries:
        body = b"".join(_varint(8 * k) + _varint(int(v)) for k, v in enumerate(e, 1) if v)
        out.append(b"\x0a" + _varint(len(body)) + body)
    return gzip.compress(b"".join(out), mtime=0)


def _unpacked(raw: bytes | None) -> list[list[int]] | None:
    try:
        raw, at, out = gzip.decompress(raw), 0, []
        while at < len(raw) and raw[at] == 0x0A:
            size, at = _take(raw, at + 1)
            end, own = at + size, [0, 0, 0, 0]
            while at < end:
                tag, at = _take(raw, at)
                own[tag // 8 - 1], at = _take(raw, at)
            out.append(own)
        return out
    except (TypeError, OSError, EOFError, IndexError, zlib.error):
        return None


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all varints of ``data``, which ends with one, and where each ends); those of over ten bytes come out wrong."""
    ends = np.flatnonzero(data < 128)
    first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(first, ends + 1 - first)
    bits = (data & 127).astype(np.uint64) << (7 * np.minimum(place, 9)).astype(np.uint64)
    return np.add.reduceat(bits, first).view(np.int64), ends + 1


def _plain(raw: bytes | None) -> bytes:
    """The bytes of a list; empty if it is null, cannot be unzipped or ends within a number."""
    try:
        raw = gzip.decompress(raw)
    except (TypeError, OSError, EOFError, zlib.error):
        return b""
    return raw if raw and raw[-1] < 128 else b""


def unpacked_lists(packed: pa.Array) -> pa.Array:
    """Entries, of four numbers each, of a batch of lists, whose numbers are decoded together.

    Such a list is a run of pairs: 10 and the size of an entry, or a field's tag and its number.
    A list of another form (a size that does not fit, other fields) is read byte by byte; one
    that cannot be read so either is null.
    """
    rows = packed.to_pylist()
    texts = [_plain(r) for r in rows]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    entries, count = np.zeros((0, 4), np.int64), np.zeros(len(rows), np.int64)
    odd = size == 0
    if size.any():
        numbers, ends = _numbers(np.frombuffer(b"".join(texts), np.uint8))
        edge = np.concatenate([[0], np.searchsorted(ends, np.cumsum(size), "right")])  # numbers before each row
        row = np.repeat(np.arange(len(rows)), np.diff(edge))
        within = np.arange(len(numbers)) - edge[row]
        odd |= np.diff(edge) % 2 == 1
        odd[row[np.diff(np.concatenate([[0], ends])) > 10]] = True
        keep = ~odd[row]
        row, within, numbers, ends = row[keep], within[keep], numbers[keep], ends[keep]
        tag, value, row, ends = numbers[::2], numbers[1::2], row[::2], ends[1::2]
        head = tag == 10
        odd[row[(within[::2] == 0) & ~head]] = True
        odd[row[~head & ~np.isin(tag, (8, 16, 24, 32))]] = True
        entry = np.cumsum(head) - 1
        if len(tag):
            # An entry ends where its last pair does.
            final = np.flatnonzero(np.append(head[1:], True) | np.append(row[1:] != row[:-1], True))
            begin = np.flatnonzero(head)
            if len(final) == len(begin):
                odd[row[begin[ends[final] - ends[begin] != value[begin]]]] = True
            else:  # a row that begins without an entry
                odd[np.unique(row)] = True
        good = ~odd[row]
        entries = np.zeros((int(head.sum()), 4), np.int64)
        cell = good & ~head
        entries[entry[cell], tag[cell] // 8 - 1] = value[cell]
        entries = entries[good[head]]
        count = np.bincount(row[head & good], minlength=len(rows))
    slow = {k: _unpacked(rows[k]) for k in np.flatnonzero(odd)}
    if any(slow.values()):
        parts = np.split(entries, np.cumsum(count)[:-1])
        for k, found in slow.items():
            parts[k] = np.array(found or [], dtype=np.uint64).view(np.int64).reshape(-1, 4)
            count[k] = len(parts[k])
        entries = np.concatenate(parts)
    missing = pa.array(np.array([k in slow and slow[k] is None for k in range(len(rows))], bool))
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(entries) + 1, 4, dtype=np.int32)), pa.array(entries.reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), inner, mask=missing)


def write_packed(ratings: DataFrame) -> DataFrame:
    """``user_id, packed``: each user's list as gzipped protobuf, in item order; ``ratings`` may have a column ``day``."""
    day = [F.col("day")] if "day" in ratings.columns else [F.lit(0)]
    numbers = F.array(*[F.col(c).cast("long") for c in ("item_id", "status", "rating")], *[d.cast("long") for d in day])
    rows = ratings.groupBy("user_id").agg(F.sort_array(F.collect_list(numbers)).alias("l"))
    pack = F.pandas_udf(lambda l: pd.Series([_packed(x) for x in l]), "binary")
    return rows.select("user_id", pack("l").alias("packed"))


def read_packed(lists: DataFrame) -> DataFrame:
    """``user_id, item_id, status, rating, day`` of gzipped protobuf lists, those of a list in order; broken lists give no rows."""
    unpack = F.arrow_udf(unpacked_lists, "array<array<bigint>>")
    return lists.select("user_id", unpack("packed").alias("l")).select("user_id", F.explode(_entries(F.col("l"))).alias("e")).select("user_id", "e.*")


def gunzipped(column: Column) -> Column:
    """Bytes of gzipped binary; null stays null."""
    return F.pandas_udf(lambda p: p.map(lambda x: None if x is None else gzip.decompress(x)), "binary")(column)


def clean_xml(text: Column) -> Column:
    """Control characters become blanks."""
    return F.regexp_replace(text, "[\\x00-\\x1f]", " ")


def read_xml_dump(dumps: DataFrame, column: str = "xml", kind: str = "anime") -> DataFrame:
    """One row for each entry of users' XML dumps of a ``kind``, with the user's id, name and counts.

    ``units`` are episodes or chapters, ``volumes`` 0 where a kind has none; ``day`` is kept for
    finished and dropped items.
    """
    parsed = dumps.select(F.from_xml(clean_xml(F.col(column)), XML_SCHEMA).alias("d"))
    user = [F.col("d.myinfo.user_id").alias("user_id"), F.col("d.myinfo.user_name").alias("username")]
    now, later = ("watching", "plantowatch") if kind == "anime" else ("reading", "plantoread")
    user += [F.coalesce(F.col(f"d.myinfo.user_{n}"), F.lit(0)).alias(f"n_{label}") for n, label in ((now, "watching"), ("completed", "completed"), ("onhold", "onhold"), ("dropped", "dropped"), (later, "planned"))]
    e = parsed.select(*user, F.explode(f"d.{kind}").alias("e"))
    units, volumes = (F.col("e.series_episodes"), F.lit(0)) if kind == "anime" else (F.col("e.series_chapters"), F.col("e.series_volumes"))
    return e.select(
        *[c for c in e.columns if c != "e"], F.col(f"e.series_{kind}db_id").alias("item_id"), F.col("e.series_title").alias("title"), F.col("e.series_type").alias("type"), units.alias("units"), volumes.alias("volumes"),
        F.col("e.series_status").alias("item_status"), F.col("e.series_start").alias("start"), F.col("e.series_end").alias("end"), F.col("e.series_image").alias("image"),
        F.col("e.my_status").alias("status"), F.col("e.my_score").alias("rating"), F.col("e.my_last_updated").alias("last_updated"), day_of(F.col("e.my_last_updated"), F.col("e.my_status")).alias("day"),
    )


def list_page(page: Column, kind: str = "anime") -> Column:
    """Entries of a JSON list page of a ``kind`` with type codes (0 for an unknown one), ISO dates and short image addresses.

    A date or an image of another form is an error.
    """
    ident, title, media, state, units, volumes = PAGE_PREFIX[kind]
    fields = dict.fromkeys((ident, title, media, state, units, volumes, f"{kind}_start_date_string", f"{kind}_end_date_string", f"{kind}_image_path", "score", "status"), "string")
    fields |= {ident: "long"} | dict.fromkeys((units, volumes, state, "score", "status"), "int")
    schema = f"array<struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>>"
    codes = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def image(url: Column) -> Column:
        short = F.regexp_extract(url, r"^(https://[^/]+)/.*(/images/(?:anime|manga)/\d+/.*\.(?:jpg|webp)).*$", 0) != ""
        parts = [F.regexp_extract(url, r"^(https://[^/]+)/.*(/images/(?:anime|manga)/\d+/.*\.(?:jpg|webp)).*$", k) for k in (1, 2)]
        return F.when(url.isNull(), None).when(short, F.concat(*parts)).when(url.contains("qm_50.gif"), "").otherwise(F.raise_error(F.concat(F.lit("unknown image "), url)).cast("string"))

    def convert(e: Column) -> Column:
        dates = [short_date(e[f"{kind}_{x}_date_string"]).alias(x) for x in ("start", "end")]
        return F.struct(
            e[ident].alias("item_id"), e[title].alias("title"), F.coalesce(F.try_element_at(codes, e[media]), F.lit(0)).alias("type"), e[units].alias("units"), (e[volumes] if kind == "manga" else F.lit(0)).alias("volumes"),
            e[state].alias("item_status"), *dates, image(e[f"{kind}_image_path"]).alias("image"), e["score"].alias("rating"), e["status"].alias("status"),
        )

    return F.transform(F.from_json(page, schema), convert)


def list_counts(entries: DataFrame) -> DataFrame:
    """``user_id`` and the number of entries of each status, as a list's own statistics."""
    names = ((1, "watching"), (2, "completed"), (3, "onhold"), (4, "dropped"), (6, "planned"))
    return entries.groupBy("user_id").agg(*[F.count_if(F.col("status") == k).alias(n) for k, n in names])

