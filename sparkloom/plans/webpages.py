"""Registered queries over web pages: the driver's pages as they are, and with parts of known layouts set into them.

A part's case is the page's number modulo the number of cases, ``{k}`` in it stands for the page's number. The SQL states what each case
must give; titles and counts come from the page around it.
"""

from __future__ import annotations

from json import dumps as _json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import pages, products
from .catalogue import table
from .rules import of_cases, sql_cases


def literal(v: object) -> str:
    """A SQL literal; ``{k}`` in a text becomes the page's number."""
    if v is None:
        return "NULL"
    if isinstance(v, bool | int | float):
        return repr(v).lower()
    text = "'" + v.replace("'", "''") + "'"
    return f"replace({text}, '{{k}}', page_id::VARCHAR)" if "{k}" in v else text


def rows_sql(cases: list, names: list[str]) -> str:
    """SQL rows (page_id, ...) of each page's case; a case is a list of rows."""
    parts = [f"SELECT page_id, {', '.join(f'{literal(v)} AS {n}' for v, n in zip(row, names, strict=True))} FROM pages WHERE page_id % {len(cases)} = {i}" for i, rows in enumerate(cases) for row in rows]
    return " UNION ALL ".join(parts)


#: The first heading of a page, as text.
HEADING = """
    trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), ''), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&'))
"""


@query(f"""
    WITH clean AS (SELECT page_id, html, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)\\s*>', '', 'g') AS h FROM pages)
    SELECT page_id, len(regexp_extract_all(h, '(?i)<a\\b[^>]*>'))::BIGINT AS links, len(regexp_extract_all(h, '(?i)<li\\b[^>]*>'))::BIGINT AS items, len(regexp_extract_all(h, '(?i)<p\\b[^>]*>'))::BIGINT AS paragraphs,
      len(regexp_extract_all(coalesce(html, ''), '(?i)<(?:script|style)\\b[^>]*>'))::BIGINT AS scripts, {HEADING} AS heading FROM clean WHERE h <> ''
""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13 (tokens), STR-10"""
    rows = pages.tokens(table(spark, sf_dir, "pages"), "page_id", "html")
    is_open = F.col("kind") == "open"
    count = lambda n: F.count_if(is_open & (F.col("name") == n))
    per = rows.groupBy("key").agg(count("a").alias("links"), count("li").alias("items"), count("p").alias("paragraphs"), F.count_if(is_open & F.col("name").isin("script", "style")).alias("scripts"))
    headings = pages.texts(rows, is_open & (F.col("name") == "h1"), "h").groupBy("key").agg(F.min_by("said", "h").alias("heading"))
    return per.join(headings, "key", "left").select(F.col("key").alias("page_id"), "links", "items", "paragraphs", "scripts", F.coalesce("heading", F.lit("")).alias("heading"))


# Addresses: (URL, family, kind, id, line, number)
ADDRESSES = [
    ("https://8maple.st/play/aB{k}-2-31.html?x=1", "maple", "playback", "aB{k}", "2", 31), ("https://PLAY.8maple.st:443/video/x9.html#a", "maple", "catalog", "x9", None, None), ("https://8maple.st/play/a-0-1.html", *[None] * 5),
    ("http://8maple.st/video/x9.html", *[None] * 5), ("https://u@8maple.st/video/x9.html", *[None] * 5), ("https://8maple.st:8443/video/x9.html", *[None] * 5), ("https://8maple.st/play/a-3000000000-1.html", *[None] * 5),
    ("https://gimytv.io/eps/{k}-a-2.html", "gimy", "playback", "{k}", None, None), ("https://www.gimytw.cc/_watch/7/", "gimy", "player", None, None, None), ("https://gimytv.io/voddetail2/{k}.html", "gimy", "catalog", "{k}", None, None),
    ("https://gimyai.tw/detail/{k}.html", "gimyai", "catalog", "{k}", None, None), ("https://www.gimyai.tw/play/{k}-1-2.html", "gimyai", "playback", "{k}", "1", 2), ("https://gimyai.tw/voddetail2/1.html", *[None] * 5),
    ("https://www.Threads.net/@who.{k}/post/Ab_c?x=1", "threads", "post", "Ab_c", "who.{k}", None), ("http://threads.com/share/tok{k}/", "threads", "share", None, None, None), ("https://threads.net/@who", *[None] * 5),
    ("https://shopee.tw/product/12/{k}/", "shopee", "product", "{k}", "12", None), ("https://www.shopee.tw/nice-thing-i.12.{k}?sp=1", "shopee", "product", "{k}", "12", None), ("https://shopee.tw/a%2Fb-i.1.2", *[None] * 5),
    ("https://shopee.tw/a%5cb-i.1.2", *[None] * 5), ("https://tw.shp.ee/aB1/", "shopee_share", "share", None, None, None), ("https://tw.shp.ee/a/b", *[None] * 5), ("https://evil.example/8maple.st/video/x.html", *[None] * 5), ("", *[None] * 5),
]


@query(rows_sql([[a[1:]] for a in ADDRESSES], ["family", "kind", "id", "line", "number"]))
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, STR-03, STR-04, STR-05, PRJ-18"""
    rows = of_cases(spark, sf_dir, "pages", "page_id", url=[a[0] for a in ADDRESSES]).withColumn("a", pages.address(F.col("url")))
    return rows.select("page_id", "a.family", "a.kind", "a.id", "a.line", "a.number")


PRODUCTS = [
    ('window.CONFIG = {a: 1, httpUrl: "https:\\/\\/shopee.tw\\/product\\/5\\/{k}"}', "5-{k}"), ('{"httpUrl" : "https://shopee.tw/x-i.7.{k}"}', "7-{k}"), ('{httpUrl: "https://shopee.tw/"}', None), ("{httpUrl: 'https://shopee.tw/product/5/6'}", None), ("no", None), ('{"httpUrl":"https:\\u002f\\u002fshopee.tw\\u002fproduct\\u002f1\\u002f2"}', "1-2"),
]


@query(f"SELECT page_id, {sql_cases('page_id', [p[1] for p in PRODUCTS])} AS product FROM pages")
def share_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-17"""
    rows = of_cases(spark, sf_dir, "pages", "page_id", script=[p[0] for p in PRODUCTS]).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    found = pages.share_product(F.concat(F.coalesce("html", F.lit("")), F.lit("<script>"), F.col("script"), F.lit("</script>")))
    return rows.select("page_id", F.concat_ws("-", found["line"], found["id"]).alias("p"), found.alias("f")).select("page_id", F.when(F.col("f").isNotNull(), F.col("p")).alias("product"))


# Catalogues: (address, part of the page, rows or a reason)
_MAPLE, _GIMY, _AI = "https://8maple.st/video/t{k}.html", "https://gimytv.io/voddetail2/{k}.html", "https://gimyai.tw/detail/{k}.html"
_tab = lambda n, name: f'<a data-toggle="tab" href="#playlist{n}">{name}</a>'
_list = lambda n, body, cls="x myui-content__list": f'<div id="playlist{n}">\n<ul class="{cls}">{body}</ul></div>'
_eps = lambda line, *labels: "".join(f'<li><a href="/play/t{{k}}-{line}-{i + 1}.html"><b>{x}</b></a></li>' for i, x in enumerate(labels))
_row = lambda line, name, order, label, number, url, place, image=None: (None, line, name, order, label, number, url, place, image)
_bad = lambda reason: [(reason, *[None] * 8)]
_at = "https://8maple.st/play/t{k}-"
CATALOGUES = [
    (_MAPLE, '<meta content="/i/{k}.jpg" property="og:image">' + _tab(1, "A &amp; B") + _tab(2, " ") + _list(2, _eps(2, "第 1 集", "特別篇")) + _list(1, _eps(1, "第1集", "第2話")),
     [_row("1", "A & B", 0, "第1集", 1, _at + "1-1.html", 0, "https://8maple.st/i/{k}.jpg"), _row("1", "A & B", 0, "第2話", 2, _at + "1-2.html", 1, "https://8maple.st/i/{k}.jpg"), _row("2", "線路 2", 1, "第 1 集", 1, _at + "2-1.html", 0, "https://8maple.st/i/{k}.jpg"), _row("2", "線路 2", 1, "特別篇", None, _at + "2-2.html", 1, "https://8maple.st/i/{k}.jpg")]),
    (_AI, '<div class="route-title"><span class="hd">HD</span> Fast</div><div class="r episodes-route" data-route-sid="3"><a href="play">no</a><a href="/play/{k}-3-1.html">01</a><a href="/play/{k}-3-2.html">2</a></div>',
     [_row("3", "Fast", 0, "01", 1, "https://gimyai.tw/play/{k}-3-1.html", 0), _row("3", "Fast", 0, "2", 2, "https://gimyai.tw/play/{k}-3-2.html", 1)]),
    (_GIMY, '<span class="video-pic" style="background:url(&quot;/p.jpg&quot;)"></span><div class="details-play-title x"><a>Line &#35;1</a></div><div class="a playlist"><ul id="con_playlist_1"><li><a href="/eps/{k}-1.html">第3集</a></li></ul></div>',
     [_row("default", "Line #1", 0, "第3集", 3, "https://gimytv.io/eps/{k}-1.html", 0, "https://gimytv.io/p.jpg")]),
    (_MAPLE, _tab(1, "A") + _list(1, _eps(1, "第1集") + '<a href="/play/t{k}-1-1.html">第2集</a>'), _bad("conflict")),
    (_MAPLE, _tab(1, "A") + _list(1, _eps(1, "第1集", "第1話")), _bad("ambiguous")),
    (_MAPLE, _tab(1, "A") + _tab(2, "B") + _list(1, _eps(1, "第1集")), _bad("missing")),
    (_MAPLE, _tab(1, "A") + _list(1, _eps(1, "第1集") + "<li><ul></ul></li>"), _bad("structure")),
    (_MAPLE, _tab(1, "A") + _list(1, _eps(1, "下載", " ") + '<a href="/play/other-1-9.html">第9集</a>'), _bad("empty")),
    ("https://8maple.st/play/t{k}-1-1.html", _tab(1, "A") + _list(1, _eps(1, "第1集")), _bad("address")),
    (_MAPLE, _tab(0, "A") + _list(0, _eps(1, "第1集")), _bad("line_number")),
    (_MAPLE, _tab(1, "A") + _tab(1, "B") + _list(1, _eps(1, "第1集")), _bad("line_names")),
    (_MAPLE, _tab(1, "A") + _list(1, _eps(1, "第1集")) * 2, _bad("blocks")),
    (_MAPLE, "<!--" + _tab(2, "B") + "-->" + _tab(1, "A") * 2 + "<script>" + _tab(3, "C") + "</script>" + _list(1, _eps(1, "第1集") * 2 + '<a href="../play/t{k}-1-1.html?again">第1話</a><a>第5集</a>'), [_row("1", "A", 0, "第1集", 1, _at + "1-1.html", 0)]),
    (_MAPLE, _tab(1, "A") + _list(1, _eps(1, "第1集"), "other"), _bad("structure")),
    (_AI, '<div class="route-title">A</div><div class="other" data-route-sid="1"></div>', _bad("blocks")),
    (_GIMY, '<div class="playlist"><ul id="con_playlist_1"></ul></div>' * 2, _bad("missing")),
    (_MAPLE, "", _bad("blocks")),
]
_NAMES = ["reason", "line", "line_name", "line_order", "label", "number", "url", "place", "image"]


def set_in(spark: SparkSession, sf_dir: str, part: list[str], **columns: list[str]) -> DataFrame:
    """The driver's pages, the case's part before the end of each."""
    rows = of_cases(spark, sf_dir, "pages", "page_id", part=part, **columns).join(table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("real")), "page_id")
    return rows.withColumn("html", F.concat(F.regexp_replace("real", r"(?is)</body\s*>.*$", ""), F.lit("</p></article></div>"), F.col("part"), F.lit("</body></html>")))


@query(f"""
    WITH expected AS ({rows_sql([c[2] for c in CATALOGUES], _NAMES)})
    SELECT page_id, reason, CASE WHEN reason IS NULL THEN coalesce(nullif({HEADING}, ''), '未命名影片 ' || CASE WHEN page_id % {len(CATALOGUES)} IN (1, 2) THEN '' ELSE 't' END || page_id) END AS title, line, line_name, line_order, label, number, expected.url, place, image
    FROM expected JOIN pages USING (page_id)
""")
def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13, AUX-12, AUX-13, JN-03, SET-05"""
    rows = set_in(spark, sf_dir, [c[1] for c in CATALOGUES], address=[c[0] for c in CATALOGUES])
    found = pages.catalogues(rows, "page_id", "address", "html")
    return found.select(F.col("key").alias("page_id"), "reason", "title", "line", "line_name", "line_order", "label", "number", "url", "place", "image")


# Posts: (address, part, rows)
_POST = "https://www.threads.net/@who/post/C{k}"
_CDN = "https://x.cdninstagram.com/v/"
_block = lambda body, cls="OuterContainer": f'<div class="a {cls}">{body}</div>'
_film, _pic = f'<video src="{_CDN}f{{k}}.mp4?a=1&amp;b=2"></video>', f'<img src="{_CDN}p{{k}}.jpg?s=1">'
_REEL = f'<div class="LinkAttachmentOuterContainer"><a href="https://www.instagram.com/reel/R{{k}}/?x"><img src="{_CDN}card.jpg?z"></a></div>'
_f = lambda name, place, url: (place, name, "video", url, None)
_p = lambda n, place, url: (place, f"ThreadsImage_C{{k}}_{n}", "image", url, url)
POSTS = [
    (_POST, _block(_film + _pic), [_f("ThreadsVideo_C{k}", 0, _CDN + "f{k}.mp4?a=1&b=2"), _p(1, 1, _CDN + "p{k}.jpg?s=1")]),
    (_POST, _block('<video src="https://video.xx.fbcdn.net/other.mp4"></video>') + _block(_pic, "OuterContainerFull"), [_p(1, 0, _CDN + "p{k}.jpg?s=1")]),
    (_POST, _block(_film) + _block('<a href="/@who/post/C{k}">x</a>' + _pic), [_p(1, 0, _CDN + "p{k}.jpg?s=1")]),
    (_POST, _block('<a href="/@who">x</a>' + _film) + _block(_pic), [_f("ThreadsVideo_C{k}", 0, _CDN + "f{k}.mp4?a=1&b=2")]),
    (_POST, _block(_film) + _block(_pic), []),
    (_POST, _film + _pic.replace("?s=1", "?s=2") + _pic, [_f("ThreadsVideo_C{k}", 0, _CDN + "f{k}.mp4?a=1&b=2"), _p(1, 1, _CDN + "p{k}.jpg?s=2")]),
    (_POST, _block(_REEL + _REEL + _film), [_f("ThreadsVideo_C{k}_1", 0, _CDN + "f{k}.mp4?a=1&b=2"), (1, "ThreadsVideo_C{k}_2", "reel", "https://www.instagram.com/reel/R{k}/", _CDN + "card.jpg?z")]),
    (_POST, _block(f'<img src="{_CDN}t51.2885-19/me.jpg"><img src="https://static.cdninstagram.com/a.png"><img src="{_CDN}rsrc.php/a.png"><i src="{_CDN}a.js">'), []),
    ("https://www.threads.net/@who", _block(_pic), [(0, "ThreadsImage_threads_1", "image", _CDN + "p{k}.jpg?s=1", _CDN + "p{k}.jpg?s=1")]),
    (_POST, _block('<a href="/&#064;who/">x</a>' + '{"u":"https:\\/\\/x.cdninstagram.com\\/v\\/e.mp4?a\\u0026b"}') + _block(_pic), [_f("ThreadsVideo_C{k}", 0, _CDN + "e.mp4?a&b")]),
]


@query(rows_sql([p[2] for p in POSTS], ["place", "name", "kind", "url", "image"]))
def post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16"""
    found = pages.post_media(set_in(spark, sf_dir, [p[1] for p in POSTS], address=[p[0] for p in POSTS]), "page_id", "address", "html")
    return found.withColumnRenamed("key", "page_id")


# Players: (address, script, reason, film, series, episode)
_PLAY, _AIPLAY = "https://8maple.st/play/t{k}-2-3.html", "https://gimyai.tw/play/{k}-2-3.html"
_data = lambda url, encrypt=0, id_="t{k}", more="": f'{{"id":"{id_}","sid":2,"nid":3,"url":"{url}","encrypt":{encrypt}{more}}}'
_name = ',"vod_data":{"vod_name":" A } B "}'
PLAYERS = [
    (_PLAY, "var player_aaaa=" + _data("https://m.example/{k}/a.m3u8", more=_name) + ";</script><script>if(a){b()}", None, "https://m.example/{k}/a.m3u8", "A } B"),
    (_AIPLAY, "player_aaaa = /* { */ " + _data("https%3A%2F%2Fm.example%2Fa%2Bb.mp4", 1, "{k}"), None, "https://m.example/a+b.mp4", None),
    (_PLAY, "var player_aaaa=" + _data("aHR0cHMlM0ElMkYlMkZtLmV4YW1wbGUlMkZ4Lm1wNA==", 2), None, "https://m.example/x.mp4", None),
    (_PLAY, "// player_aaaa={\nvar s='player_aaaa={', player_aaaa=" + _data("https://m.example/q.mp4?a={}"), None, "https://m.example/q.mp4?a={}", None),
    (_PLAY, "player_aaaa={};player_aaaa={}", "player", None, None), (_PLAY, "var player_bbbb={}", "player", None, None), (_PLAY, "player_aaaa={id:1}", "format", None, None), (_PLAY, "player_aaaa=" + _data("https://m.example/a.mp4", 0, "other"), "other", None, None),
    (_PLAY, "player_aaaa=" + _data(" "), "no_url", None, None), (_PLAY, "player_aaaa=" + _data("x", 3), "encoding", None, None), (_PLAY, "player_aaaa=" + _data("%%%", 2), "encoding", None, None), (_PLAY, "player_aaaa=" + _data("ftp://m.example/a.mp4"), "scheme", None, None),
    (_PLAY, "player_aaaa=" + _data("https://m.example/a.html"), "file", None, None), ("https://8maple.st/video/t{k}.html", "player_aaaa=" + _data("https://m.example/a.mp4"), "address", None, None), (_PLAY, 'player_aaaa={"a":"}', "player", None, None), (_PLAY, "player_aaaa={'a':'}'}", "format", None, None),
]


@query(f"""
    WITH expected AS ({rows_sql([[p[2:]] for p in PLAYERS], ["reason", "url", "series"])})
    SELECT page_id, reason, expected.url, series, CASE WHEN reason IS NULL THEN coalesce(nullif({HEADING.replace("h1", "title")}, ''), series, CASE WHEN page_id % {len(PLAYERS)} = 1 THEN 'gimy_' ELSE '8maple_t' END || page_id) END AS title FROM expected JOIN pages USING (page_id)
""")
def player_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, STR-13"""
    rows = set_in(spark, sf_dir, [f"<script>{p[1]}</script>" for p in PLAYERS], address=[p[0] for p in PLAYERS])
    return pages.players(rows, "page_id", "address", "html").select(F.col("key").alias("page_id"), "reason", "url", "series", "title")


_EPS = "https://gimytv.io/eps/{k}-1.html"
_frame = '<iframe src="/_watch/{k}" name="p-frame"></iframe>'
_dp = lambda url: f"<script>var a; const url = {url}; new DPlayer ({{video: {{ url : url, x: 1}}}})</script>"
FRAMES = [
    (_EPS, _frame, _dp('"https:\\/\\/m.example\\/{k}.m3u8?t=1"'), None, "https://gimytv.io/_watch/{k}", "https://m.example/{k}.m3u8?t=1"), (_EPS, _frame, _dp("'http://m.example/\\x61.MP4'"), None, "https://gimytv.io/_watch/{k}", "http://m.example/a.MP4"),
    (_EPS, _frame * 2, _dp("'https://m.example/a.mp4'"), "frame", None, None), (_EPS, "<iframe src='/other' name='p-frame'>", _dp("'https://m.example/a.mp4'"), "frame", None, None), (_EPS, "<iframe src='/_watch/1'>", _dp("'https://m.example/a.mp4'"), "frame", None, None),
    (_EPS, _frame, _dp("'https://m.example/a.mp4'") * 2, "literal", None, None), (_EPS, _frame, "<script>var url='https://m.example/a.mp4';</script>", "literal", None, None), (_EPS, _frame, _dp("'https://m.example/\\q'"), "literal", None, None),
    (_EPS, _frame, _dp("'https://m.example/a.html'"), "file", None, None), (_EPS, _frame, _dp("'https://u:p@m.example/a.mp4'"), "file", None, None), ("https://gimyai.tw/play/1-1-1.html", _frame, _dp("'https://m.example/a.mp4'"), "address", None, None),
]


@query(rows_sql([[f[3:]] for f in FRAMES], ["reason", "player", "url"]))
def frame_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15"""
    rows = set_in(spark, sf_dir, [f[1] for f in FRAMES], address=[f[0] for f in FRAMES], player=[f[2] for f in FRAMES])
    return pages.frame_players(rows, "page_id", "address", "html", "player").withColumnRenamed("key", "page_id")


# Product snapshots: (snapshot, rows)
_snap = lambda images, videos, **other: _json({"documentUrl": "https://shopee.tw/product/5/{k}", "documentMatches": True, "found": True, "shopId": "5", "itemId": "{k}", "gallerySourceCount": len(images), "galleryComplete": True, "imageHashes": images, "itemHasVideo": bool(videos), "videoSourceCount": len(videos), "videos": videos} | other)
_mp4 = lambda n, **other: {"url": f"https://a.vod.susercontent.com/{n}.mp4"} | other
_shot = lambda n, h: (n - 1, f"ShopeeImage_5_{{k}}_{n}", products.IMAGE_BASE + h, products.IMAGE_BASE + h, None, None, None)
SNAPSHOTS = [
    (_snap(["a-{k}", "b_2"], []), [_shot(1, "a-{k}"), _shot(2, "b_2")]),
    (_snap(["a"], [{"durationSeconds": 9, "thumbnail": "t-{k}", "formats": [_mp4("x", width=10, height=90, codec="hevc"), _mp4("y", width=9, height=5, size="77", codec="H.264"), _mp4("z", width=5, height=9, size=88, codec="avc1")]}, {"thumbnail": "http://no", "formats": [_mp4("w", size=0)]}], more=1),
     [(0, "ShopeeVideo_5_{k}_1", "https://a.vod.susercontent.com/z.mp4", products.IMAGE_BASE + "t-{k}", 9, 9, 88), (1, "ShopeeVideo_5_{k}_2", "https://a.vod.susercontent.com/w.mp4", None, None, None, None), (2, "ShopeeImage_5_{k}_1", products.IMAGE_BASE + "a", products.IMAGE_BASE + "a", None, None, None)]),
    (_snap(["a"], [], itemHasVideo=True), []), (_snap(["a", "b c"], []), []), (_snap([], []), []), (_snap(["a"], [], gallerySourceCount=2), []), (_snap(["a"], [], shopId=5), []), (_snap(["a"], [], itemId="other"), []), (_snap(["a"], [], galleryComplete=False), []), (_snap(["a"], [], found=None), []),
    (_snap(["a"], [], documentUrl="https://shopee.tw/product/5/1{k}"), []), (_snap(["a"], [{"formats": []}]), []), (_snap(["a"], [{"formats": [_mp4("x"), {"url": "https://a.example/x.mp4"}]}]), []), (_snap(["a"] * 51, []), []), ("{broken", []), (_snap(["a"], [{"formats": [{"url": "https://a.vod.susercontent.com/x.webm"}]}]), []), (_snap(["a", None], []), []),
]


@query(rows_sql([s[1] for s in SNAPSHOTS], ["place", "name", "url", "image", "seconds", "height", "bytes"]))
def product_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, SRT-06"""
    rows = of_cases(spark, sf_dir, "pages", "page_id", snapshot=[s[0] for s in SNAPSHOTS]).withColumns({"shop": F.lit("5"), "item": F.col("page_id").cast("string")})
    return products.product_media(rows, "page_id", "snapshot", "shop", "item").withColumnRenamed("key", "page_id")
