"""Fields of the fixed HTML pages that describe users, items and profiles, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastegraph.functions.scores import relative_date

# Fixed values of the pages.
RELATIONS = {"Side story": 1, "Alternative version": 2, "Sequel": 3, "Other": 4, "Prequel": 5, "Parent story": 6, "Full story": 7}
TITLE_KINDS = {"English:": 1, "Synonyms:": 2}


def plain(html: Column) -> Column:
    """Text of a piece of HTML: no tags, the five usual references decoded, white space as one blank."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def usernames(html: Column) -> Column:
    """Names of the profile links that hold a picture, in page order, repeats included."""
    return F.regexp_extract_all(html, F.lit(r'<a\b[^>]*\bhref="/profile/([^"]+)"[^>]*>(?:(?!</a>)[\s\S])*?<img\b'), 1)


def relations(html: Column, kind: str = "anime") -> Column:
    """``array<struct<related_id, relation>>``: cells of the relations table folded in order.

    A cell that names a relation holds for the next cell with links; cells in between are passed over.
    """
    table = F.regexp_extract(html, r'(?s)<table\b[^>]*class="[^"]*anime_detail_related_anime[^"]*"[^>]*>(.*?)</table>', 1)
    cells = F.regexp_extract_all(table, F.lit(r"(?s)<td\b[^>]*>(.*?)</td>"), 1)
    codes = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    none = F.lit(None).cast("int")
    start = F.struct(F.array().cast("array<struct<related_id:bigint,relation:int>>").alias("found"), none.alias("relation"))

    def step(state: Column, cell: Column) -> Column:
        code = F.try_element_at(codes, F.regexp_replace(plain(cell), ":$", ""))
        links = F.regexp_extract_all(cell, F.lit(rf'<a\b[^>]*\bhref="/{kind}/(\d+)/'), 1)
        own = F.transform(links, lambda x: F.struct(x.cast("bigint").alias("related_id"), state["relation"].alias("relation")))
        use = state["relation"].isNotNull() & (F.size(links) > 0)
        return (
            F.when(code.isNotNull(), F.struct(state["found"].alias("found"), code.alias("relation")))
            .when(use, F.struct(F.concat(state["found"], own).alias("found"), none.alias("relation")))
            .otherwise(state)
        )

    return F.aggregate(cells, start, step, lambda s: s["found"])


def genres(html: Column, kind: str = "anime") -> Column:
    """``array<struct<genre_id, description>>`` of the links behind the label of genres."""
    part = F.regexp_extract(html, r"(?s)<span\b[^>]*>\s*Genres:\s*</span>(.*?)</div>", 1)
    link = rf'(?s)<a\b[^>]*\bhref="[^"]*/{kind}/genre/(\d+)/[^"]*"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all(part, F.lit(link), 1).alias("a"), F.regexp_extract_all(part, F.lit(link), 2).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p["a"].cast("int").alias("genre_id"), plain(p["b"]).alias("description")))


def alternative_titles(html: Column) -> Column:
    """``array<struct<title, title_type>>``: comma-separated names behind the labels of English titles and synonyms."""
    part = F.regexp_extract(html, r"(?s)<h2\b[^>]*>(?:(?!</h2>).)*Alternative Titles.*?</h2>(.*?)(?:<h2\b|$)", 1)
    span = r"(?s)<span\b[^>]*>\s*(English:|Synonyms:)\s*</span>([^<]*)"
    pairs = F.arrays_zip(F.regexp_extract_all(part, F.lit(span), 1).alias("a"), F.regexp_extract_all(part, F.lit(span), 2).alias("b"))
    codes = F.create_map(*[F.lit(x) for pair in TITLE_KINDS.items() for x in pair])
    return F.flatten(F.transform(pairs, lambda p: F.transform(F.split(plain(p["b"]), ","), lambda t: F.struct(F.trim(t).alias("title"), F.element_at(codes, p["a"]).alias("title_type")))))


def item_stats(html: Column) -> Column:
    """``struct<score, rank, popularity>``: score in hundredths; 0 for what the page lacks."""
    block = F.regexp_extract(html, r'(?s)<div\b[^>]*class="[^"]*stats-block[^"]*"(.*)', 1)
    number = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(block, pattern, 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.struct(
        F.round(number(r'(?s)<div\b[^>]*class="[^"]*\bscore\b[^"]*"[^>]*>\s*(\d+\.?\d+)') * 100).cast("int").alias("score"),
        number(r'(?s)<span\b[^>]*class="[^"]*\branked\b[^"]*"[^>]*>(?:(?!</span>).)*?#(\d+)').cast("int").alias("rank"),
        number(r'(?s)<span\b[^>]*class="[^"]*\bpopularity\b[^"]*"[^>]*>(?:(?!</span>).)*?#(\d+)').cast("int").alias("popularity"),
    )


def item_page(html: Column, kind: str = "anime") -> Column:
    """``struct<relations, genres, titles, scores>`` of an item's page."""
    return F.struct(relations(html, kind).alias("relations"), genres(html, kind).alias("genres"), alternative_titles(html).alias("titles"), item_stats(html).alias("scores"))


def profile_page(html: Column, as_of: Column, zone: str = "America/Los_Angeles") -> Column:
    """``struct<user_id, username, anime_count, manga_count, anime_update, manga_update>`` of a profile; null without an id or a name.

    The id comes from the link to comments, else the feed's, else the one for reports; a kind
    without updates counts as changed at 0.
    """
    first = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    user = F.coalesce(first(r'href="[^"]*/comments\.php\?id=(\d+)'), first(r'href="[^"]*/rss\.php\?type=\w+&(?:amp;)?id=(\d+)'), first(r'href="[^"]*go=report&(?:amp;)?type=profile&(?:amp;)?id=(\d+)'))
    name = first(r'href="[^"]*/animelist/([^"]+)"')
    count = lambda kind: F.regexp_replace(first(rf'(?s)<div\b[^>]*class="[^"]*\bstats {kind}\b[^"]*".*?<ul\b[^>]*stats-data.*?<span\b[^>]*>.*?</span>\s*<span\b[^>]*>([\d,]+)<'), ",", "").cast("long")
    when = lambda kind: F.coalesce(relative_date(first(rf'(?s)<div\b[^>]*class="[^"]*\bupdates {kind}\b[^"]*"(?:(?!class="[^"]*\bupdates\b).)*?<div\b[^>]*class="data".*?<span\b[^>]*>([^<]*)</span>'), as_of, zone), F.lit(0))
    fields = F.struct(user.cast("long").alias("user_id"), name.alias("username"), count("anime").alias("anime_count"), count("manga").alias("manga_count"), when("anime").alias("anime_update"), when("manga").alias("manga_update"))
    return F.when(user.isNotNull() & name.isNotNull(), fields)
