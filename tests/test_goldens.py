"""Fixed expectations: title searches, dates, pages, dumps and list pages, on rebuilt inputs."""

import gzip

import pytest
from pyspark.sql import functions as F

from tastegraph.functions import scores as S
from tastegraph.operators import search
from tastegraph.sources import lists, pages

# Titles, queries and the ids or titles that answer them, best first.
BASIC = [(1, 0, "Koutetsujou no Kabaneri"), (2, 0, "Cowboy Bebop"), (3, 0, "K-on!")]
ALIASES = [(1, 7, "Gakkougurashi!"), (1, 8, "School-Live!"), (2, 9, "Higurashi no Naku Koro ni"), (2, 10, "When the Cicadas Cry"), (2, 11, "The Moment the Cicadas Cry")]
FUZZY = {"k-on": [3, 1], "K on": [3, 1], "Cowboy": [2], "o": [3], "no": [1], "on": [3]}
ONE_WORD = {
    "k": True, "o": False, "ko": True, "kt": False, "kou": True, "kot": True, "kuo": True, "xko": True, "kxo": True, "kxu": True, "krx": False,
    "koutet": True, "kouetu": True, "kouxtxet": True, "koxtxt": True, "kuotte": True, "koxuxtext": False,
}
SUBSTRING = {"k-on": [3, 1], "K on": [3, 1], "Cowboy": [2], "o": [3, 2, 1]}
CICADAS = {
    "cicada": [(2, "The Moment the Cicadas Cry")], "moment cicada": [(2, "The Moment the Cicadas Cry")], "cicada moment": [(2, "The Moment the Cicadas Cry")],
    "when cicada": [(2, "When the Cicadas Cry")], "cicada when": [(2, "When the Cicadas Cry")], "school": [(1, "School-Live!")],
}


def answers(spark, suggest, titles, queries, ranks=()):
    t = spark.createDataFrame(titles, "item_id long, title_id int, title string")
    r = spark.createDataFrame(list(ranks), "item_id long, rank int")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    found = {x: [] for x in queries}
    for row in suggest(t, r, q, 5).orderBy("query", "rk").collect():
        found[row["query"]].append((row["item_id"], row["title"]))
    return found


def ids(found):
    return {q: [i for i, _ in rows] for q, rows in found.items()}


def test_fuzzy_search(spark):
    assert ids(answers(spark, search.fuzzy_suggest, BASIC, FUZZY)) == FUZZY
    assert ids(answers(spark, search.fuzzy_suggest, BASIC[:1], ONE_WORD)) == {q: [1] if hit else [] for q, hit in ONE_WORD.items()}
    want = CICADAS | {"gurashi": [(2, "Higurashi no Naku Koro ni")]}
    assert answers(spark, search.fuzzy_suggest, ALIASES, want) == want


def test_substring_search(spark):
    assert ids(answers(spark, search.substring_suggest, BASIC, SUBSTRING)) == SUBSTRING
    want = CICADAS | {"gurashi": [(2, "Higurashi no Naku Koro ni"), (1, "Gakkougurashi!")]}
    assert answers(spark, search.substring_suggest, ALIASES, want) == want
    sequels = [(1, 0, "K-on!"), (2, 0, "K-on!!"), (3, 0, "K-on! Movie")]
    for ranks, order in (([(1, 7), (2, 5), (3, 1)], [3, 2, 1]), ([(1, 1), (2, 2), (3, 3)], [1, 2, 3])):
        assert ids(answers(spark, search.substring_suggest, sequels, ["k-on!"], ranks)) == {"k-on!": order}


def test_every_match_shares_a_key(spark):
    """No word that a query matches is lost by the keys, against a comparison of all pairs."""
    import itertools

    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)][:250] + ["abcabca", "cabcabcab", "bbbbbbb"]
    queries = ["a", "ab", "abc", "cba", "abca", "bacab", "abcabc", "cabcab", "acbacba"]
    got = search.near_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(q,) for q in queries], "q string"))
    want = {(q, w, *search.edit_state(q, w)) for q in queries for w in words if search.edit_state(q, w)}
    assert {tuple(r) for r in got.select("q", "word", "skipped", "distance", "level").collect()} == want


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fuzzy_dates(spark):
    """Times of day lie in the Pacific zone; the instant is 2017-08-20 19:00:07 UTC, noon there."""
    now = 1503255607
    at = lambda text: value(spark, S.relative_date(F.lit(text), F.timestamp_seconds(F.lit(now)), "America/Los_Angeles"))
    assert at("now") == now and at("4 seconds ago") == now - 4
    assert at("1 minute ago") == (now - 60) // 60 * 60 and at("2 hours ago") == (now - 7200) // 3600 * 3600
    assert at("Today, 2:46 AM") == 1503222360 and at("Yesterday, 3:10 AM") == 1503137400
    assert at("Aug 18, 3:10 PM") == 1503094200 and at("Jun 14, 2017 1:17 AM") == 1497428220
    assert at("some day") is None


def test_users_page(spark):
    page = "".join(f'<td><a class="u" href="/profile/name{k}"><img src="{k}.jpg"></a><a href="/profile/name{k}">name</a></td>' for k in range(20))
    found = value(spark, pages.usernames(F.lit(page)))
    assert len(found) == 20 and found[0] == "name0" and found[19] == "name19"


ITEM = """<html><h2>Edit</h2><div>x</div><h2>Alternative Titles</h2><div class="spaceit_pad"><span class="dark_text">English:</span> Gintama </div>
<div class="spaceit_pad"><span class="dark_text">Synonyms:</span> Gin Tama, Silver Soul, Yorinuki Gintama-san </div><div><span class="dark_text">Japanese:</span> other </div><h2>Information</h2>
<div><span class="dark_text">Genres:</span> <a href="/anime/genre/1/Action" title="Action">Action</a>, <a href="/anime/genre/24/Sci-Fi">Sci-Fi</a> </div>
<div class="stats-block"><div class="fl-l score" data-title="score">9.00</div><span class="numbers ranked">Ranked <strong>#13</strong></span><span class="numbers popularity">Popularity <strong>#94</strong></span></div>
<table class="anime_detail_related_anime"><tr><td>Adaptation:</td><td><a href="/manga/44/x">x</a></td></tr><tr><td>Side story:</td><td><a href="/anime/2951/a">a</a>, <a href="/anime/6945/b">b</a></td></tr>
<tr><td>Alternative version:</td><td>none</td><td><a href="/anime/7472/c">c</a></td></tr><tr><td>Sequel:</td><td><a href="/anime/9969/d">d</a></td></tr><tr><td><a href="/anime/5/lost">lost</a></td></tr></table></html>"""


def test_item_page(spark):
    p = value(spark, pages.item_page(F.lit(ITEM)))
    assert {r["related_id"]: r["relation"] for r in p["relations"]} == {2951: 1, 6945: 1, 7472: 2, 9969: 3}
    assert [tuple(g) for g in p["genres"]] == [(1, "Action"), (24, "Sci-Fi")]
    assert {t["title"]: t["title_type"] for t in p["titles"]} == {"Gintama": 1, "Gin Tama": 2, "Silver Soul": 2, "Yorinuki Gintama-san": 2}
    assert tuple(p["scores"]) == (900, 13, 94)
    bare = value(spark, pages.item_page(F.lit("<html>nothing</html>"), "manga"))
    assert (bare["relations"], bare["genres"], bare["titles"], tuple(bare["scores"])) == ([], [], [], (0, 0, 0))
    manga = ITEM.replace("/anime/", "/manga/")
    assert {r["related_id"] for r in value(spark, pages.item_page(F.lit(manga), "manga"))["relations"]} == {2951, 6945, 7472, 9969}


PROFILE = """<h1><a href="/modules.php?go=report&amp;type=profile&amp;id=9">Report</a></h1><div class="user-profile"><div class="user-button"><a href="https://x.example/animelist/mattia_y">list</a></div>%s</div>
<div class="stats anime"><ul class="stats-data"><li><span>Total Entries</span><span>1,560</span></li><li><span>Rewatched</span><span>7</span></li></ul></div><div class="updates anime">%s</div>
<div class="stats manga"><ul class="stats-data"><li><span>Total Entries</span><span>34</span></li></ul></div><div class="updates manga">%s</div>"""
UPDATE = '<div class="statistics"><div class="data"><a href="/x">x</a><div><span>%s</span></div></div></div>'


def test_profile_page(spark):
    now = F.timestamp_seconds(F.lit(1503255607))
    page = PROFILE % ('<div class="user-comments"><h2><a href="/comments.php?id=5621220">c</a></h2></div>', UPDATE % "14 minutes ago", UPDATE % "Mar 14, 8:19 AM")
    p = value(spark, pages.profile_page(F.lit(page), now))
    assert tuple(p) == (5621220, "mattia_y", 1560, 34, (1503255607 - 840) // 60 * 60, 1489504740)
    private = PROFILE % ('<div class="user-profile-sns"><a href="/rss.php?type=blog&id=5661231">b</a></div>', "<p>private</p>", "")
    assert tuple(value(spark, pages.profile_page(F.lit(private), now))) == (5661231, "mattia_y", 1560, 34, 0, 0)
    assert value(spark, pages.profile_page(F.lit(PROFILE % ("", "", "")), now))["user_id"] == 9
    assert value(spark, pages.profile_page(F.lit("<html></html>"), now)) is None


def dump(kind, entry):
    return f"<x><myinfo><user_id>5621220</user_id><user_name>mattia_y</user_name><user_watching>8</user_watching><user_reading>3</user_reading><user_completed>230</user_completed><user_onhold>0</user_onhold><user_dropped>25</user_dropped><user_plantowatch>232</user_plantowatch><user_plantoread>9</user_plantoread></myinfo><{kind}>{entry}</{kind}><{kind}><series_{kind}db_id>2</series_{kind}db_id><my_status>1</my_status></{kind}></x>"


def test_xml_dumps(spark):
    entry = "<series_animedb_id>1</series_animedb_id><series_title>Cowboy\x01 Bebop</series_title><series_type>1</series_type><series_episodes>26</series_episodes><series_status>2</series_status><series_start>1998-04-03</series_start><series_end>1999-04-24</series_end><series_image>i.webp</series_image><my_score>8</my_score><my_status>2</my_status><my_last_updated>1471101172</my_last_updated><unknown>1</unknown>"
    rows = lists.read_xml_dump(spark.createDataFrame([(dump("anime", entry),)], "xml string")).orderBy("item_id").collect()
    first = rows[0].asDict()
    assert len(rows) == 2 and (first["user_id"], first["username"], first["n_watching"], first["n_completed"], first["n_onhold"], first["n_dropped"], first["n_planned"]) == (5621220, "mattia_y", 8, 230, 0, 25, 232)
    assert [first[c] for c in ("item_id", "title", "type", "units", "item_status", "start", "end", "image", "rating", "status", "last_updated", "day")] == [1, "Cowboy  Bebop", 1, 26, 2, "1998-04-03", "1999-04-24", "i.webp", 8, 2, 1471101172, 17026]
    assert rows[1]["day"] == 0
    entry = "<series_mangadb_id>3468</series_mangadb_id><series_title>Usagi Drop</series_title><series_chapters>62</series_chapters><series_volumes>10</series_volumes><my_score>8</my_score><my_status>2</my_status>"
    row = lists.read_xml_dump(spark.createDataFrame([(dump("manga", entry),)], "xml string"), kind="manga").where("item_id = 3468").first()
    assert (row["title"], row["units"], row["volumes"], row["n_watching"], row["n_planned"]) == ("Usagi Drop", 62, 10, 3, 9)


def test_list_pages(spark):
    page = '[{"anime_id":1,"anime_title":"Cowboy Bebop","anime_media_type_string":"TV","anime_num_episodes":26,"anime_airing_status":2,"anime_start_date_string":"04-03-98","anime_end_date_string":"04-24-49","anime_image_path":"https://cdn.x.example/r/96x136/images/anime/4/19644.webp?s=1","score":8,"status":2,"more":1},{"anime_id":2,"anime_title":"t","anime_media_type_string":"Odd","anime_start_date_string":null,"anime_image_path":"https://cdn.x.example/images/qm_50.gif"}]'
    one, two = value(spark, lists.list_page(F.lit(page)))
    assert tuple(one) == (1, "Cowboy Bebop", 1, 26, 0, 2, "1998-04-03", "2049-04-24", "https://cdn.x.example/images/anime/4/19644.webp", 8, 2)
    assert (two["type"], two["start"], two["image"]) == (0, "0000-00-00", "")
    page = '[{"manga_id":3468,"manga_title":"Usagi Drop","manga_media_type_string":"Novel","manga_num_chapters":62,"manga_num_volumes":10,"manga_publishing_status":2,"manga_start_date_string":"10-08-05","manga_image_path":"https://cdn.x.example/r/1/images/manga/2/203854.webp","score":8,"status":2}]'
    row = value(spark, lists.list_page(F.lit(page), "manga"))[0]
    assert (row["type"], row["units"], row["volumes"], row["start"]) == (2, 62, 10, "2005-10-08")
    for bad in ('[{"anime_id":1,"anime_start_date_string":"1998"}]', '[{"anime_id":1,"anime_image_path":"http://elsewhere"}]'):
        with pytest.raises(Exception):
            spark.range(1).select(lists.list_page(F.lit(bad)).alias("x")).collect()


def test_packed_lists(spark):
    rows = [(1, 300, 2, 9, 12000), (1, 7, 6, 0, 0), (2, 2**40, 4, 10, 1)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, status int, rating int, day int")
    packed = lists.write_packed(df)
    raw = gzip.decompress(packed.where("user_id = 1").first()["packed"])
    # Fields 1 to 4 as varints, zeros left out: 300 is ac 02, 12000 is e0 5d.
    assert raw == bytes.fromhex("0a04" + "08071006" + "0a0a" + "08ac02" + "1002" + "1809" + "20e05d")
    assert sorted(tuple(r) for r in lists.read_packed(packed).collect()) == sorted(rows)
    broken = spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "user_id long, packed binary")
    assert lists.read_packed(broken).count() == 0
    held = gzip.compress(b"text", mtime=0)
    assert spark.createDataFrame([(bytearray(held),)], "b binary").select(lists.gunzipped(F.col("b"))).first()[0] == b"text"
    assert value(spark, S.unpacked(F.lit("dGV4dA=="))) == b"text" and value(spark, S.unpacked(F.lit("***"))) is None


def test_json_lists_are_sorted_and_days_kept_for_ended_items(spark):
    df = spark.createDataFrame([(1, "[[5,2,9,12],[3,1,0,7]]")], "user_id long, list string")
    assert [tuple(r) for r in lists.read_lists(df).collect()] == [(1, 3, 1, 0, 0), (1, 5, 2, 9, 12)]
