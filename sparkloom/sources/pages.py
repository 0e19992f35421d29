"""Web pages as rows: page addresses, HTML tokens that know what encloses them, and the media that pages of known layouts offer.

``tokens`` reads a page once, with a stack of open elements, and gives each token the element around it and each element the token
that ends it. What lies inside a block, a link or a heading is then a window over the tokens, not another pass over the
text. Layout rules are joins and aggregates over tokens; a page that breaks one gives its reason and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks, text, udfs
from ..streaming.folds import from_ddl

# Hosts and paths of the sites whose pages are known, and marks of their layouts
HOSTS = {
    "maple": ("8maple.st", "www.8maple.st", "play.8maple.st"),
    "gimy": ("gimytv.io", "www.gimytv.io", "gimytw.cc", "www.gimytw.cc"),
    "gimyai": ("gimyai.tw", "www.gimyai.tw"),
    "shopee": ("shopee.tw", "www.shopee.tw"),
    "shopee_share": ("tw.shp.ee",),
}
#: Family, kind, path, and the groups that hold the id, the line and the number (0: none).
PATHS = [
    ("maple", "playback", r"^/play/([A-Za-z0-9]+)-(\d+)-(\d+)\.html$", 1, 2, 3),
    ("maple", "catalog", r"^/video/([A-Za-z0-9]+)\.html$", 1, 0, 0),
    ("gimy", "playback", r"^/eps/(\d+)-([A-Za-z0-9-]+)\.html$", 1, 0, 0),
    ("gimy", "player", r"^/_watch/\d+/?$", 0, 0, 0),
    ("gimy", "catalog", r"^/voddetail2/(\d+)\.html$", 1, 0, 0),
    ("gimyai", "catalog", r"^/detail/(\d+)\.html$", 1, 0, 0),
    ("gimyai", "playback", r"^/play/(\d+)-(\d+)-(\d+)\.html$", 1, 2, 3),
    ("shopee", "product", r"^/product/([0-9]+)/([0-9]+)/?$", 2, 1, 0),
    ("shopee", "product", r"^(?!.*(?i:%2f|%5c))/[^/]+-i\.([0-9]+)\.([0-9]+)/?$", 2, 1, 0),
    ("shopee_share", "share", r"^/[A-Za-z0-9]+/?$", 0, 0, 0),
]
POST = r"^(?i:https?://(?:www\.)?threads\.(?:net|com))/@([^/?#]+)/post/([^/?#]+)/?(?:[?#].*)?$"
SHARE = r"^(?i:https?://(?:www\.)?threads\.(?:net|com))/share/[^/?#]+/?(?:[?#].*)?$"
NOT_EPISODES = ("立即播放", "立即觀看", "播放", "下載", "廣告", "广告", "推薦影片", "推荐影片", "更多好片")
EPISODE = r"^第\s*(\d+)\s*[集話]$"
PICTURES = ("jpg", "jpeg", "png", "webp", "heic")
MEDIA_LINK = r"(?i)https://[a-z0-9_.-]*(?:cdninstagram\.com|fbcdn\.net)/[^\"'\\ )<>]+"
POST_BLOCK = r"(?i)(?=<div[^>]*class=\"(?:[^\"]*\s)?OuterContainer[^\"]*\")"
LINK_CARD = r"(?is)<div[^>]*class=\"[^\"]*\bLinkAttachmentOuterContainer\b[^\"]*\"[^>]*>.*?</a>\s*</div>"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
TOKENS = "key long, i int, kind string, name string, attrs map<string,string>, text string, parent int, until int"
_MARKUP = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


_NUMBER = re.compile(r"&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});")


def _decoded(value: str) -> str:
    """A text with its numeric entities decoded, then the named ones in their order."""
    if "&" not in value:
        return value

    def number(m: re.Match) -> str:
        code = int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    value = _NUMBER.sub(number, value)
    for name, plain_ in text.ENTITIES.items():
        value = value.replace(name, plain_)
    return value


def _read(html: str) -> list[list]:
    """A page's tokens: [kind, name, attributes, text, parent, until]."""
    out: list[list] = []
    open_: list[int] = []
    at = 0

    def put(kind: str, name: str, attrs: list | None, text_: str | None) -> None:
        out.append([kind, name, attrs, text_, open_[-1] if open_ else -1, len(out) + 1])

    while at < len(html):
        m = _MARKUP.search(html, at)
        if m is None or m.start() > at:
            put("text", "", None, _decoded(html[at : m.start() if m else len(html)]))
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if any(out[j][1] == name for j in open_):
                while out[j := open_.pop()][1] != name:
                    out[j][5] = len(out)
                out[j][5] = len(out)
            continue
        put("open", name, [(a.lower(), _decoded(d or s or "").strip()) for a, d, s in _ATTRIBUTE.findall(m[3])], None)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if end is not None:
                open_.append(len(out) - 1)
                put("raw", name, None, html[at : end.start()])
                out[open_.pop()][5] = len(out)
                at = end.end()
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            open_.append(len(out) - 1)
    for j in open_:
        out[j][5] = len(out)
    return out


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Tokens of each page: elements (``open``), texts and the bodies of scripts and styles (``raw``), in order.

    ``parent`` is the element around a token, ``until`` the first token after what an element holds. Comments give none; an end without its
    begin is passed over; elements that are not ended end with the one around them. Entities in texts and attributes are decoded.
    A null page has none.
    """
    kinds = from_ddl(TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = _read(x or "")
                for lo in range(0, len(found), 4096):
                    rows = [(k, lo + n, t[0], t[1], dict(t[2]).items() if t[2] is not None else None, *t[3:]) for n, t in enumerate(found[lo : lo + 4096])]
                    yield pa.RecordBatch.from_arrays([pa.array([list(r[4]) if r[4] is not None else None for r in rows] if f.name == "attrs" else [r[j] for r in rows], f.type) for j, f in enumerate(kinds)], schema=kinds)

    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(run, TOKENS)


def inside(rows: DataFrame, element: Column, name: str) -> DataFrame:
    """Tokens with ``name``: the last element of a kind begun before them that still holds them; elements of the kind do not nest."""
    begun = F.last(F.when(element, F.struct("i", "until")), ignorenulls=True).over(W.partitionBy("key").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.when(begun["until"] > F.col("i"), begun["i"]))


def plain(c: Column) -> Column:
    """Text without tags, with numeric and named entities decoded, trimmed."""
    parts = F.regexp_extract_all(F.regexp_replace(c, "<[^>]*>", ""), F.lit(r"(?s)(&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});|[^&]+|&)"), F.lit(1))

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#(x?[0-9a-fA-F]+);$", 1)
        code = F.when(F.startswith(digits, F.lit("x")), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(part)

    numbers = F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(c)
    return F.regexp_replace(text.strip_tags(numbers), r"^\s+|\s+$", "")


def media_file(url: Column) -> Column:
    """Whether a URL is an HTTP one, without user info, of a playlist or an MP4."""
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    return http(url) & F.rlike(path, F.lit(r"\.(m3u8|mp4)$"))


def http(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"^https?://[^/?#@\s]+(?:[/?#]\S*)?$")), F.lit(False))


def texts(rows: DataFrame, element: Column, name: str) -> DataFrame:
    """(key, name, said): the text in each element of a kind."""
    held = inside(rows, element, name).where(F.col(name).isNotNull())
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("i", "text"))))
    return held.groupBy("key", name).agg(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), ""), r"^\s+|\s+$", "").alias("said"))


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), name)


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


# Addresses


def address(url: Column) -> Column:
    """struct<family, kind, id, line, number> of a page on a known site; null if it is none.

    HTTPS without user info or a foreign port; the path is taken as it is written, and line and number must be positive.
    """
    fine = ~F.rlike(url, F.lit(r"[\s\"<>\\^`{|}]|%(?![0-9A-Fa-f]{2})"))
    host = F.lower(F.regexp_extract(url, r"^(?i:https)://([^/?#@:\[\]]+)(?::443)?(?=[/?#]|$)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    known = lambda family, kind, pattern, *groups: F.struct(F.lit(family).alias("family"), F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"), *(F.lit(g).alias(n) for g, n in zip(groups, ("g1", "g2", "g3"), strict=True)))

    def of_path(x: Column) -> Column:
        out = F.when(F.rlike(url, F.lit(SHARE)), known("threads", "share", "", 0, 0, 0)).when(F.rlike(url, F.lit(POST)), known("threads", "post", POST, 2, 1, 0))
        for family, kind, pattern, *groups in PATHS:
            out = out.when(x["fine"] & x["host"].isin(*HOSTS[family]) & F.rlike(x["path"], F.lit(pattern)), known(family, kind, pattern, *groups))
        return text.let(out, lambda k: read(x, k))

    def read(x: Column, k: Column) -> Column:
        whole = F.when(k["family"] == "threads", url).otherwise(x["path"])
        group = lambda n: F.when(k[n] > 0, F.call_function("regexp_extract", whole, k["pattern"], k[n]))
        number, playing = group("g3").try_cast("int"), k["g3"] > 0
        line = F.when(playing, group("g2").try_cast("int").cast("string")).otherwise(group("g2"))
        good = ~playing | F.coalesce((number > 0) & (line.try_cast("int") > 0), F.lit(False))
        return F.when(k.isNotNull() & good, F.struct(k["family"].alias("family"), k["kind"].alias("kind"), group("g1").alias("id"), line.alias("line"), number.alias("number")))

    return text.let(F.struct(fine.alias("fine"), host.alias("host"), path.alias("path")), of_path)


def share_product(html: Column) -> Column:
    """AUX-17: the product address in a share page's ``httpUrl`` JSON string, which is decoded and not run; null if there is none."""
    said = F.regexp_extract(html, r'[,{]\s*(?:httpUrl|"httpUrl")\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    found = address(F.get_json_object(F.concat(F.lit('{"u":'), said, F.lit("}")), "$.u"))
    return F.when(found["kind"] == "product", found)


# Catalogues


def thumbnails(rows: DataFrame) -> DataFrame:
    """AUX-12, (key, image): the page's picture, else the picture in its poster's style."""
    og = F.when((F.col("name") == "meta") & (attribute("property") == "og:image"), attribute("content"))
    style = F.regexp_extract(F.coalesce(attribute("style"), F.lit("")), r"url\(\s*['\"]?([^)'\"\s]+)['\"]?\s*\)", 1)
    poster = F.when(F.col("name").isin("span", "div") & has_class("video-pic"), F.nullif(style, F.lit("")))
    marked = rows.where("kind = 'open'").select("key", "i", og.alias("og"), poster.alias("poster"))
    picked = marked.groupBy("key").agg(F.min_by("og", F.when(F.col("og").isNotNull(), F.col("i"))).alias("og"), F.min_by("poster", F.when(F.col("poster").isNotNull(), F.col("i"))).alias("poster"))
    return picked.select("key", F.coalesce("og", "poster").alias("image"))


def _lines(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, line, line_name, line_order, list) of the lines that each catalogue shows, and (key, reason) where its layout is broken.

    Three layouts: tabs with a block each, titled routes, and one default list. ``links``: the text of each link, (key, i, said).
    What several rules look at is kept: it is a few rows a page, and each rule would else read all tokens again.
    """
    is_open, a = F.col("kind") == "open", F.col("name") == "a"
    lead = lambda c, n=1: F.lead(c, n).over(W.partitionBy("key").orderBy("i"))
    solid = rows.where(~((F.col("kind") == "text") & F.rlike("text", F.lit(r"^\s*$"))))
    # a block is an element whose only child is the list
    blocks = solid.withColumns({"next": lead(F.struct("i", "name", "attrs", "parent", "until")), "after": F.lit(None)}).where(is_open & (F.col("name") == "div") & (F.col("next.name") == "ul") & (F.col("next.parent") == F.col("i")))
    ends = rows.where(~((F.col("kind") == "text") & F.rlike("text", F.lit(r"^\s*$")))).groupBy("key", "parent").agg(F.count("*").alias("children"))
    blocks = blocks.join(ends.withColumnRenamed("parent", "i"), ["key", "i"]).where("children = 1").select("key", "i", "family", "attrs", "next").persist()
    maple = rows.where("family = 'maple'")
    tabs = maple.where(is_open & a & (attribute("data-toggle") == "tab")).withColumn("line", F.regexp_extract(attribute("href"), r"^#playlist(\d+)$", 1)).where("line <> ''")
    tabs = tabs.select("key", "i", "line").join(links, ["key", "i"]).withColumn("line_name", F.when(F.col("said") == "", F.concat(F.lit("線路 "), F.col("line"))).otherwise(F.col("said"))).persist()
    bad_tabs = tabs.groupBy("key").agg(F.bool_or(~F.coalesce(F.col("line").try_cast("int") > 0, F.lit(False))).alias("bad")).where("bad").select("key", F.lit("line_number").alias("reason"))
    per_tab = tabs.groupBy("key", "line").agg(F.min("i").alias("i"), F.min_by("line_name", "i").alias("line_name"), F.count_distinct("line_name").alias("names"))
    clash = per_tab.where("names > 1").select("key", F.lit("line_names").alias("reason")).distinct()
    mine = blocks.where((F.col("family") == "maple") & F.rlike(F.coalesce(attribute("id"), F.lit("")), F.lit(r"^playlist\d+$")))
    mine = mine.select("key", F.substr(attribute("id"), F.lit(9)).alias("line"), F.col("next.i").alias("list"), F.array_contains(F.split(F.coalesce(F.try_element_at("next.attrs", F.lit("class")), F.lit("")), r"\s+"), "myui-content__list").alias("known"))
    twice = mine.groupBy("key", "line").count().where("count > 1").select("key", F.lit("blocks").alias("reason")).distinct()
    none = maple.select("key").distinct().join(per_tab.select("key").distinct(), "key", "left_anti").select("key", F.lit("blocks").alias("reason"))
    tabbed = per_tab.join(mine, ["key", "line"], "left").withColumn("line_order", F.row_number().over(W.partitionBy("key").orderBy("i")) - 1).persist()
    lost = tabbed.groupBy("key").agg(F.bool_or(F.col("list").isNull()).alias("lost"), F.bool_or(~F.col("known")).alias("odd")).where("lost OR odd").select("key", F.when(F.col("lost"), "missing").otherwise("structure").alias("reason"))

    ai = solid.where("family = 'gimyai'")
    titles = texts(rows.where("family = 'gimyai'"), is_open & (F.col("name") == "div") & (F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")) == "route-title"), "title")
    hidden = inside(rows.where("family = 'gimyai'"), is_open & (F.col("name") == "span") & (F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")) == "hd"), "hd").where("hd IS NULL").drop("hd")
    titles = texts(hidden, is_open & (F.col("name") == "div") & (F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")) == "route-title"), "title").unionByName(titles.withColumn("said", F.lit(""))).groupBy("key", "title").agg(F.max("said").alias("said"))
    after = ai.select("key", F.col("i").alias("next_i"), "name", "attrs", "kind", "parent")
    heads = ai.where(is_open & (F.col("name") == "div") & (F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")) == "route-title")).select("key", F.col("i").alias("title"), F.col("until").alias("stop"), F.col("parent").alias("of"))
    follow = heads.join(after, "key").where((F.col("next_i") >= F.col("stop"))).groupBy("key", "title", "of").agg(F.min_by(F.struct("next_i", "name", "attrs", "kind", "parent"), "next_i").alias("n"))
    routes = follow.where((F.col("n.kind") == "open") & (F.col("n.name") == "div")).join(titles, ["key", "title"])
    sid = F.try_element_at("n.attrs", F.lit("data-route-sid"))
    routes = routes.select("key", "title", F.col("n.next_i").alias("list"), sid.alias("line"), "said", F.array_contains(F.split(F.coalesce(F.try_element_at("n.attrs", F.lit("class")), F.lit("")), r"\s+"), "episodes-route").alias("known")).persist()
    no_route = ai.select("key").distinct().join(routes.select("key").distinct(), "key", "left_anti").select("key", F.lit("missing").alias("reason"))
    number = F.coalesce(F.col("line").try_cast("int") > 0, F.lit(False))
    bad_route = routes.groupBy("key").agg(F.bool_or(~number).alias("n"), F.bool_or(~F.col("known")).alias("k"), (F.count_distinct("line") < F.count("line")).alias("d")).where("n OR k OR d").select("key", F.when(F.col("n"), "line_number").otherwise("blocks").alias("reason"))
    routed = routes.withColumn("line_order", F.row_number().over(W.partitionBy("key").orderBy("title")) - 1).select("key", "line", F.when(F.col("said") == "", F.concat(F.lit("線路 "), F.col("line"))).otherwise(F.col("said")).alias("line_name"), "line_order", "list")

    lone = blocks.where((F.col("family") == "gimy") & has_class("playlist") & F.rlike(F.coalesce(F.try_element_at("next.attrs", F.lit("id")), F.lit("")), F.lit(r"^con_playlist_\d+$")))
    header = inside(inside(rows.where("family = 'gimy'"), is_open & (F.col("name") == "div") & F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")).contains("details-play-title"), "head"), is_open & a, "link")
    header = header.where("head IS NOT NULL AND link IS NOT NULL").groupBy("key").agg(F.min_by("link", F.struct("head", "link")).alias("i")).join(links, ["key", "i"]).where("said <> ''").select("key", F.col("said").alias("line_name"))
    lists = lone.groupBy("key").agg(F.count("*").alias("n"), F.min("next.i").alias("list"))
    single = lists.where("n = 1").join(header, "key", "left").select("key", F.lit("default").alias("line"), F.coalesce("line_name", F.lit("在線播放")).alias("line_name"), F.lit(0).alias("line_order"), "list")
    not_one = rows.where("family = 'gimy'").select("key").distinct().join(lists.where("n = 1"), "key", "left_anti").select("key", F.lit("missing").alias("reason"))
    lines = tabbed.select("key", "line", "line_name", "line_order", "list").unionByName(routed).unionByName(single)
    reasons = bad_tabs.union(clash).union(twice).union(none).union(lost).union(no_route).union(bad_route).union(not_one)
    return lines, reasons


def catalogues(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """SRC-13, (key, reason, title, image, line, line_name, line_order, label, number, url, place): every episode of every line.

    A page that is no catalogue, whose layout is broken or whose episodes contradict each other gives its reason alone (``address``,
    ``line_number``, ``line_names``, ``blocks``, ``missing``, ``structure``, ``conflict``, ``ambiguous``, ``empty``, the first of them).
    Links to other titles, without a label or with a label that is no episode are passed over; of links with one path the first counts.
    """
    known = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("page"), html).withColumn("a", address(F.col("page")))
    good = known.where("a.kind = 'catalog'").select("key", "page", F.col("a.family").alias("family"), F.col("a.id").alias("own"), html)
    # many rules look at the tokens: they are read once and kept, and read again where an executor that held some is lost
    rows = tokens(good, "key", html).where("kind <> 'raw'").join(good.select("key", "family", "own", "page"), "key").repartition("key").persist()
    is_open = F.col("kind") == "open"
    links = texts(rows, is_open & (F.col("name") == "a"), "link").withColumnRenamed("link", "i").persist()
    lines, reasons = _lines(rows, links)
    lines = lines.persist()
    heading = texts(rows, is_open & (F.col("name") == "h1"), "h").groupBy("key").agg(F.min_by("said", "h").alias("series"))
    # links of a list: what is inside its borders; lists do not overlap
    lists = rows.where(is_open).select("key", F.col("i").alias("list"), F.col("until").alias("end")).join(lines, ["key", "list"])
    marked = rows.join(lists.select("key", F.col("list").alias("i"), F.col("line").alias("of_line")), ["key", "i"], "left")
    marked = inside(marked, F.col("of_line").isNotNull(), "list").where(is_open & F.col("list").isNotNull() & F.col("name").isin("a", "ul")).persist()
    nested = marked.where(is_open & (F.col("name") == "ul") & F.col("list").isNotNull() & (F.col("list") != F.col("i"))).select("key", F.lit("structure").alias("reason")).distinct()
    found = marked.where(is_open & (F.col("name") == "a") & F.col("list").isNotNull() & attribute("href").isNotNull()).join(links, ["key", "i"]).join(lines, ["key", "list"])
    found = found.withColumn("link", udfs.resolve_url("page", attribute("href"))).withColumn("to", address(F.col("link")))
    same = (F.col("to.kind") == "playback") & (F.col("to.family") == F.col("family")) & (F.col("to.id") == F.col("own")) & ((F.col("family") == "gimy") | (F.col("to.line") == F.col("line").try_cast("int").cast("string")))
    found = found.where(same & (F.col("said") != "") & ~F.col("said").isin(*NOT_EPISODES))
    number = F.regexp_extract("said", EPISODE, 1).try_cast("int")
    number = F.coalesce(number, F.when(F.col("family") == "gimyai", F.when(F.rlike("said", F.lit(r"^\d+$")), F.col("said")).try_cast("int")))
    found = found.withColumns({"number": number, "path": F.regexp_extract("link", r"^[^:]+://[^/?#]*([^?#]*)", 1)})
    of_path, of_page = W.partitionBy("key", "line", "path").orderBy("i"), W.partitionBy("key")
    found = found.withColumns({"nth": F.row_number().over(of_path), "first": F.first(F.struct("said", "number")).over(of_path)})
    differs = (F.col("nth") > 1) & (F.col("said") != F.col("first.said")) & ~F.coalesce(F.col("number") == F.col("first.number"), F.lit(False))
    alike = F.count_if((F.col("nth") == 1) & F.col("number").isNotNull()).over(W.partitionBy("key", "line", "number"))
    found = found.withColumns({"alike": alike, "place": F.row_number().over(W.partitionBy("key", "line", F.col("nth") == 1).orderBy("i")) - 1})
    found = found.withColumns({"conflict": F.bool_or(differs).over(of_page), "ambiguous": F.bool_or((F.col("nth") == 1) & F.col("number").isNotNull() & (F.col("alike") > 1)).over(of_page)})
    once = found.where("nth = 1").select("key", "line", "line_name", "line_order", F.col("said").alias("label"), "number", F.col("link").alias("url"), "place", "conflict", "ambiguous")
    order = ["line_number", "line_names", "blocks", "missing", "structure"]
    broken = reasons.union(nested).groupBy("key").agg(F.min_by("reason", F.array_position(F.array(*map(F.lit, order)), F.col("reason"))).alias("broken"))
    joined = known.select("key", "page", F.col("a.kind").alias("kind"), F.col("a.id").alias("own")).join(broken, "key", "left").join(once, "key", "left")
    reason = F.when(~F.coalesce(F.col("kind") == "catalog", F.lit(False)), "address").when(F.col("broken").isNotNull(), F.col("broken"))
    reason = reason.when(F.col("conflict"), "conflict").when(F.col("ambiguous"), "ambiguous").when(F.col("line").isNull(), "empty")
    joined = joined.withColumns({"reason": reason, "nth": F.row_number().over(of_page.orderBy("line_order", "place"))}).where("reason IS NULL OR nth = 1")
    titled = joined.join(heading, "key", "left").join(thumbnails(rows), "key", "left")
    none = F.concat(F.lit("未命名影片 "), F.col("own"))
    fine = lambda c, name: F.when(F.col("reason").isNull(), c).alias(name)
    values = [fine(F.col(c), c) for c in ("line", "line_name", "line_order", "label", "number", "url", "place")]
    return titled.select("key", "reason", fine(F.coalesce(F.nullif("series", F.lit("")), none), "title"), fine(udfs.resolve_url("page", "image"), "image"), *values)


# Posts


def post_media(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """SRC-16, (key, place, name, kind, url, image): media of the one post that an embedded page was asked for.

    Such a page may hold the posts above it too, each in a block of its own. The post is the block marked as full, else the only one
    that links to its code, else the only one that links to its author, else the only one there is; of several others none is
    taken. Films come first, then linked reels, then pictures; of links with one path the first counts, portraits and
    parts of the page itself are none, and the picture of a reel's card is that reel's.
    """
    said = F.col(html)
    for old, new in (("\\u0026", "&"), ("&amp;", "&"), ("\\/", "/"), ("&#064;", "@"), ("&#64;", "@")):
        said = F.replace(said, F.lit(old), F.lit(new))
    known = pages.select(F.col(key).alias("key"), address(F.col(url)).alias("a"), F.coalesce(said, F.lit("")).alias("html"))
    known = known.withColumns({"code": F.when(F.col("a.kind") == "post", F.col("a.id")), "author": F.when(F.col("a.kind") == "post", F.col("a.line"))})
    parts = F.split("html", POST_BLOCK)
    begins = F.rlike("html", F.lit(POST_BLOCK))
    # what stands before the first block is none; with a block at the very begin there is nothing before it
    cut = F.when(F.rlike(parts[0], F.lit("^" + POST_BLOCK.replace("(?i)", "(?i)", 1))), parts).otherwise(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    known = known.withColumn("blocks", cut)
    only = lambda test: F.when(F.size(F.filter("blocks", test)) == 1, F.filter("blocks", test)[0])
    full = F.get(F.filter("blocks", lambda b: F.contains(b, F.lit("OuterContainerFull"))), F.lit(0))
    coded = F.when(F.col("code").isNotNull(), only(lambda b: F.contains(b, F.concat(F.lit("/post/"), F.col("code")))))
    named = lambda b: F.exists(F.array(*map(F.lit, ("?", '"', "/"))), lambda end: F.contains(b, F.concat(F.lit("/@"), F.col("author"), end)))
    written = F.when(F.col("author").isNotNull(), only(named))
    scope = F.when(~begins, F.col("html")).otherwise(F.coalesce(full, coded, written, only(lambda b: F.lit(True)), F.lit("")))
    rows = known.select("key", F.coalesce("code", F.lit("threads")).alias("code"), scope.alias("scope"))
    links = lambda c: F.regexp_extract_all(c, F.lit(f"({MEDIA_LINK})".replace("((?i)", "((?i)")), F.lit(1))
    path = lambda u: F.substring_index(u, "?", 1)
    ending = lambda u: F.lower(F.regexp_extract(path(u), r"\.([^.]*)$", 1))
    portrait = lambda u: F.rlike(u, F.lit(r"/t51\.\d+-19/"))
    picture = lambda u: ending(u).isin(*PICTURES) & ~portrait(u) & ~checks.static_asset(u)
    cards = F.transform(F.regexp_extract_all("scope", F.lit(f"({LINK_CARD})"), F.lit(1)), lambda c: F.struct(checks.reel_url(F.regexp_extract(c, r"(?i)href=\"([^\"]+)\"", 1)).alias("url"), F.get(F.filter(links(c), picture), F.lit(0)).alias("image")))
    rows = rows.withColumns({"cards": F.filter(cards, lambda c: c["url"].isNotNull()), "found": F.filter(links(F.col("scope")), lambda u: ~checks.static_asset(u) & (ending(u).isin("mp4", *PICTURES)))})
    firsts = lambda c, of: F.filter(c, lambda x, i: F.array_position(F.transform(c, of), of(x)) == i + 1)
    rows = rows.withColumns({"cards": firsts("cards", lambda c: c["url"]), "found": firsts("found", path)})
    shown = F.transform("cards", lambda c: F.coalesce(path(c["image"]), F.lit("")))
    item = lambda kind, u, image: F.struct(F.lit(kind).alias("kind"), u.alias("url"), image.alias("image"))
    films = F.transform(F.filter("found", lambda u: ending(u) == "mp4"), lambda u: item("video", u, F.lit(None).cast("string")))
    reels = F.transform("cards", lambda c: item("reel", c["url"], c["image"]))
    images = F.transform(F.filter("found", lambda u: (ending(u) != "mp4") & ~portrait(u) & ~F.array_contains(shown, path(u))), lambda u: item("image", u, u))
    rows = rows.withColumns({"moving": F.concat(films, reels), "still": images})
    rows = rows.select("key", "code", F.size("moving").alias("moving"), F.posexplode(F.concat("moving", "still")).alias("place", "m"))
    name = F.when(F.col("m.kind") == "image", F.concat(F.lit("ThreadsImage_"), F.col("code"), F.lit("_"), (F.col("place") - F.col("moving") + 1).cast("string")))
    name = name.otherwise(checks.video_name(F.col("code"), F.col("place"), F.col("moving")))
    return rows.select("key", "place", name.alias("name"), "m.kind", "m.url", "m.image")


# Players

PLAYER = "struct<id:string,sid:string,nid:string,url:string,encrypt:string,vod_data:struct<vod_name:string>>"


def script_objects(bodies: Column, name: str) -> Column:
    """The objects assigned to a name in the code of scripts: strings and comments are passed over, and end no object."""
    return udfs.script_objects(name)(bodies)


def players(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """SRC-14, (key, reason, url, title, series, episode) of playback pages that state their film in a script.

    Reasons, the first that holds: ``address`` (no playback page), ``player`` (not one object assigned), ``format`` (no JSON object), ``other`` (of another
    episode), ``no_url``, ``encoding`` (0 plain, 1 escaped, 2 Base64 and escaped are known), ``scheme`` (no HTTP address), ``file`` (no playlist or MP4).
    """
    known = pages.select(F.col(key).alias("key"), address(F.col(url)).alias("a"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    known = known.withColumns({"objects": script_objects(bodies, "player_aaaa"), "title": F.nullif(plain(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit(""))})
    one = F.get("objects", F.lit(0))
    known = known.withColumns({"one": one, "p": F.from_json(one, PLAYER, {"mode": "PERMISSIVE"})})
    number = lambda n: F.get_json_object("one", f"$.{n}").try_cast("int")
    raw = F.get_json_object("one", "$.url")
    unscripted = F.decode(F.try_to_binary(raw, F.lit("base64")), "ISO-8859-1")
    decoded = F.when(number("encrypt") == 0, raw).when(number("encrypt") == 1, udfs.unescape_script(raw)).when(number("encrypt") == 2, udfs.unescape_script(unscripted))
    known = known.withColumn("media", decoded)
    of_page = (F.get_json_object("one", "$.id") == F.col("a.id")) & (number("sid") == F.col("a.line").try_cast("int")) & (number("nid") == F.col("a.number"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(no((F.col("a.kind") == "playback") & F.col("a.family").isin("maple", "gimyai")), "address").when(F.size("objects") != 1, "player")
    reason = reason.when(F.try_parse_json("one").isNull(), "format").when(no(of_page), "other").when(no(F.trim(raw) != ""), "no_url").when(no(number("encrypt").isin(0, 1, 2)) | F.col("media").isNull(), "encoding")
    reason = reason.when(~http(F.col("media")), "scheme").when(~media_file(F.col("media")), "file")
    series = F.nullif(F.trim(F.get_json_object("one", "$.vod_data.vod_name")), F.lit(""))
    out = known.withColumns({"reason": reason, "series": series})
    fine = F.col("reason").isNull()
    prefix = F.when(F.col("a.family") == "maple", "8maple_").otherwise("gimy_")
    title = F.coalesce("title", "series", F.concat(prefix, F.col("a.id")))
    return out.select("key", "reason", F.when(fine, F.col("media")).alias("url"), F.when(fine, title).alias("title"), F.when(fine, F.col("series")).alias("series"), F.when(fine, F.regexp_extract("title", r"第\s*(\d+)\s*[集話]", 1).try_cast("int")).alias("episode"))


def frame_players(pages: DataFrame, key: str, url: str, html: str, player_html: str) -> DataFrame:
    """SRC-15, (key, reason, player, url) of playback pages whose film stands in a named frame's script as a string.

    Reasons: ``address`` (no such playback page), ``frame`` (not one frame ``p-frame`` that leads to a player), ``literal`` (not one string assigned to
    ``url`` in a script that gives it to a player), ``file`` (no HTTP playlist or MP4).
    """
    known = pages.select(F.col(key).alias("key"), F.col(url).alias("page"), address(F.col(url)).alias("a"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.coalesce(F.col(player_html), F.lit("")).alias("frame"))
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<iframe\b[^>]*>)"), F.lit(1))
    value = lambda tag, n: F.try_element_at(F.filter(text.attributes(tag), lambda a: a["name"] == n), F.lit(-1))["value"]
    sources = F.transform(F.filter(tags, lambda t: F.coalesce(value(t, "name") == "p-frame", F.lit(False)) & value(t, "src").isNotNull()), lambda t: value(t, "src"))
    known = known.withColumns({"n": F.size(sources), "player": udfs.resolve_url("page", plain(F.get(sources, F.lit(0))))})
    bodies = F.regexp_extract_all("frame", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    used = F.filter(bodies, lambda b: F.rlike(b, F.lit(r"new\s+DPlayer\s*\(")) & F.rlike(b, F.lit(r"video\s*:\s*\{\s*url\s*:\s*url\s*[,}]")))
    literals = F.flatten(F.transform(used, lambda b: F.regexp_extract_all(b, F.lit(r"\b(?:var|let|const)\s+url\s*=\s*(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')\s*;"), F.lit(1))))
    known = known.withColumns({"literals": F.size(literals), "media": udfs.script_literal(F.get(literals, F.lit(0)))})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(no((F.col("a.kind") == "playback") & (F.col("a.family") == "gimy")), "address").when((F.col("n") != 1) | no(address(F.col("player"))["kind"] == "player"), "frame")
    reason = reason.when((F.col("literals") != 1) | F.col("media").isNull(), "literal").when(~media_file(F.col("media")), "file")
    out = known.withColumn("reason", reason)
    return out.select("key", "reason", *(F.when(F.col("reason").isNull(), F.col(c)).alias(n) for c, n in (("player", "player"), ("media", "url"))))
