"""Registered queries for playlists as text, checks, requests, stored records and sound, over generated cases.

Texts come from lists of cases, good and malformed ones; a case's row number is the key modulo their number, and ``{k}`` stands for the
key. The SQL states what each must give. Numbers are made from keys by rules that the SQL repeats, and judged by
its own predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, udfs
from ..registry import query
from ..sources import manifests
from .catalogue import TASKS_SQL, r6, table, tasks
from .media import cases, pick

BASE = "https://m.example/v/list.m3u8"


def of_cases(spark: SparkSession, sf_dir: str, source: str, key: str, **columns: list) -> DataFrame:
    """(key, ...): each column's case for the key."""

    def one(values: list) -> Column:
        chosen = pick(cases(*values), F.col(key) % len(values))
        return F.replace(chosen, F.lit("{k}"), F.col(key).cast("string")) if any(isinstance(v, str) for v in values) else chosen

    return table(spark, sf_dir, source).select(key, *(one(v).alias(n) for n, v in columns.items()))


def sql_cases(key: str, values: list, kind: str = "VARCHAR") -> str:
    """The SQL of a case's value."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool | int | float):
            return str(v).lower() if isinstance(v, bool) else repr(v)
        return "'" + str(v).replace("'", "''").replace("\n", "'||chr(10)||'").replace("\r", "'||chr(13)||'") + "'"

    chosen = f"list_extract([{', '.join(map(literal, values))}]::{kind}[], ({key} % {len(values)} + 1)::INT)"
    return f"replace({chosen}, '{{k}}', {key}::VARCHAR)" if kind == "VARCHAR" else chosen


# Playlists: (text, segments to resume with or None, whether it is complete and plain, whether it has regions)
_HEAD, _END = "#EXTM3U\n#EXT-X-VERSION:3\n", "#EXT-X-ENDLIST"
_TWO = "#EXTINF:4.5,a\ns{k}.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:2,\n\nt.TS?x=1\n"
PLAYLISTS = [
    (_HEAD + _TWO + _END, 2, True, True),
    (_HEAD + _TWO, None, False, False),
    (_TWO + _END, None, False, False),
    (_HEAD + "#EXT-X-KEY:METHOD=NONE\n#EXT-X-PLAYLIST-TYPE:VOD\n" + _TWO + _END + "\n\n", 2, True, True),
    (_HEAD + "#EXT-X-KEY:METHOD=AES-128\n" + _TWO + _END, None, False, False),
    (_HEAD + "#EXTINF:1,\n#EXTINF:1,\na.ts\n" + _END, None, False, False),
    (_HEAD + "#EXTINF:-1,\na.ts\n" + _END, None, False, False),
    (_HEAD + "#EXTINF:1e400,\na.ts\n" + _END, None, False, False),
    (_HEAD + "#EXTINF:abc,\na.ts\n" + _END, None, False, False),
    (_HEAD + "a.ts\n" + _END, None, False, False),
    (_HEAD + "#EXTINF:1,\na.mp4\n" + _END, None, False, False),
    (_HEAD + "#EXTINF:1,\nftp://h/a.ts\n" + _END, None, False, False),
    (_HEAD + "#EXTINF:1,\nhttps://u@h/a.ts\n" + _END, None, False, False),
    (_HEAD + "#EXT-X-MAP:URI=x\n" + _TWO + _END, None, False, False),
    (_HEAD + _END, None, False, False),
    (_HEAD + "#EXTINF:1,\na.ts\n" + _END + "\n#EXTINF:2,\nb.ts\n" + _END, None, True, False),
    (_HEAD + "#EXTINF:1,\n#EXT-X-DISCONTINUITY\na.ts\n" + _END, 1, True, False),
    (_HEAD + "#EXTINF:1\na.ts\n" + _END, 1, True, False),
    ("\r\n" + _HEAD.replace("\n", "\r\n") + "# said\r\n  #EXTINF:3,  \r\nhttps://h/{k}%2Ets\r\n" + _END, 1, True, True),
    (_HEAD + "# ppvod-ad-injected v1\n#EXTINF:9,\na.ts\n#EXT-X-DISCONTINUITY\n#EXT-X-DISCONTINUITY\n#EXTINF:8,\nb.ts\n" + _END, 2, True, True),
    ("", None, False, False),
]


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_cases(spark, sf_dir, "orders", "o_orderkey", text=[p[0] for p in PLAYLISTS])


_TEXT = sql_cases("o_orderkey", [p[0] for p in PLAYLISTS])


@query(f"""
    SELECT o_orderkey, {sql_cases("o_orderkey", [p[1] for p in PLAYLISTS], "BIGINT")} AS segments,
      CASE WHEN {sql_cases("o_orderkey", [p[2] for p in PLAYLISTS], "BOOLEAN")} THEN sha256({_TEXT}) END AS fingerprint, {sql_cases("o_orderkey", [p[3] for p in PLAYLISTS], "BOOLEAN")} AS parsed FROM orders
""")
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-08, SRC-09"""
    return manifests.checks(playlists(spark, sf_dir), "o_orderkey", "text", BASE)


def parsed_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playlists(spark, sf_dir).where(pick(cases(*(p[3] for p in PLAYLISTS)), F.col("o_orderkey") % len(PLAYLISTS)))


_KINDS = f"(SELECT o_orderkey, o_orderkey % {len(PLAYLISTS)} AS v FROM orders) WHERE v IN (0, 3, 18, 19)"


@query(f"""
    SELECT o_orderkey, i AS segment, CASE v WHEN 18 THEN 0 WHEN 19 THEN 2 * i ELSE i END::BIGINT AS region,
      CASE v WHEN 18 THEN 3 WHEN 19 THEN 9 - i ELSE 4.5 - 2.5 * i END::DOUBLE AS seconds,
      CASE v WHEN 18 THEN 'https://h/' || o_orderkey || '%2Ets' WHEN 19 THEN 'https://m.example/v/' || chr(97 + i::INT) || '.ts' ELSE 'https://m.example/v/' || CASE i WHEN 0 THEN 's' || o_orderkey || '.ts' ELSE 't.TS?x=1' END END AS url,
      v = 19 AND i = 0 AS marked FROM (SELECT o_orderkey, v, unnest(range(CASE v WHEN 18 THEN 1 ELSE 2 END)) AS i FROM {_KINDS})
""")
def manifest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, WIN-05"""
    return manifests.segments(parsed_playlists(spark, sf_dir), "o_orderkey", "text", BASE).drop("duration_line", "line")


@query(f"""
    SELECT o_orderkey, i AS region, CASE i WHEN 0 THEN 'playlist_start' ELSE 'discontinuity' END AS start_boundary, CASE WHEN i = CASE v WHEN 18 THEN 0 WHEN 19 THEN 2 ELSE 1 END THEN 'playlist_end' ELSE 'discontinuity' END AS end_boundary,
      CASE v WHEN 18 THEN [3.0] WHEN 19 THEN [9.0, 0.0, 8.0] ELSE [4.5, 2.0] END[i + 1]::DOUBLE AS seconds, CASE WHEN v = 19 AND i = 1 THEN 0 ELSE 1 END::BIGINT AS segments, v = 19 AND i = 0 AS marked
    FROM (SELECT o_orderkey, v, unnest(range(CASE v WHEN 18 THEN 1 WHEN 19 THEN 3 ELSE 2 END)) AS i FROM {_KINDS})
""")
def manifest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, WIN-05, AGG-13"""
    p = parsed_playlists(spark, sf_dir)
    return manifests.regions(p, "o_orderkey", "text", manifests.segments(p, "o_orderkey", "text", BASE))


@query(f"""
    SELECT o_orderkey, CASE v WHEN 18 THEN replace({_TEXT}, 'https://h/' || o_orderkey || '%2Ets' || chr(13) || chr(10), '') WHEN 19 THEN replace({_TEXT}, '#EXTINF:9,' || chr(10) || 'a.ts' || chr(10), '') ELSE replace({_TEXT}, '#EXTINF:4.5,a' || chr(10) || 's' || o_orderkey || '.ts' || chr(10), '') END AS manifest
    FROM (SELECT o_orderkey, o_orderkey % {len(PLAYLISTS)} AS v FROM orders) WHERE v IN (0, 3, 19)
    UNION ALL SELECT o_orderkey, chr(13) || chr(10) || '#EXTM3U' || chr(13) || chr(10) || '#EXT-X-VERSION:3' || chr(13) || chr(10) || '# said' || chr(13) || chr(10) || '#EXT-X-ENDLIST' FROM orders WHERE o_orderkey % {len(PLAYLISTS)} = 18
""")
def filtered_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02"""
    p = parsed_playlists(spark, sf_dir)
    return manifests.without(p, "o_orderkey", "text", manifests.segments(p, "o_orderkey", "text", BASE).where("segment = 0"))


_STREAM = "#EXT-X-STREAM-INF:BANDWIDTH=1,RESOLUTION=2x2\n"
MASTERS = [
    ("#EXTM3U\n" + _STREAM + "hd/{k}.m3u8", "https://m.example/v/hd/{k}.m3u8"),
    ("#EXTM3U\n#EXT-X-VERSION:4\n# note\n" + _STREAM + "\nhttps://o.example/x.m3u8\n", "https://o.example/x.m3u8"),
    ("#EXTM3U\n" + _STREAM + "a\n" + _STREAM + "b", None),
    ("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1, AUDIO=\"a\"\na", None),
    ("#EXTM3U\n" + _STREAM + "# a\nb", None),
    ("#EXTM3U\n" + _STREAM, None),
    ("#EXTM3U\nb", None),
    ("#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO\n" + _STREAM + "a", None),
    (_STREAM + "a", None),
    ("#EXTM3U\n" + _STREAM + "ftp://h/a", None),
]


@query(f"SELECT o_orderkey, {sql_cases('o_orderkey', [m[1] for m in MASTERS])} AS url FROM orders")
def single_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10"""
    return manifests.single_variant(of_cases(spark, sf_dir, "orders", "o_orderkey", text=[m[0] for m in MASTERS]), "o_orderkey", "text", BASE)


URLS = [
    ("https://a.example/{k}?q=1", True), ("HTTP://h", True), ("http://h:0/x", False), ("http://h:70000/x", False), ("http://h:/x", True), ("https://u:p@h/x", False), ("https://h/a b", False),
    ("https://h/#f", False), ("ftp://h/x", False), ("//h/x", False), ("https:///x", False), ("https://[::1]:8080/x", True), ("https://h/\n", False), ("", False),
]


@query(f"SELECT o_orderkey, {sql_cases('o_orderkey', [u[1] for u in URLS], 'BOOLEAN')} AS plain FROM orders")
def http_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-01"""
    return of_cases(spark, sf_dir, "orders", "o_orderkey", url=[u[0] for u in URLS]).select("o_orderkey", manifests.http_url(F.col("url")).alias("plain"))


# Files, plans and sessions


@query("""
    SELECT page_id, CASE WHEN page_id % 7 = 1 OR page_id % 5 = 2 THEN 'refused' WHEN page_id % 4 = 3 OR page_id % 6 = 5 OR html IS NULL OR html = '' THEN CASE WHEN coalesce(html, '') = '' THEN 'refused' ELSE 'stale' END ELSE 'valid' END AS state,
      coalesce(page_id % 4 <> 3 AND page_id % 6 <> 5 AND html IS NOT NULL, false) AS intact FROM pages
""")
def cached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-02, AUX-09"""
    p, html = F.col("page_id"), F.col("html").cast("binary")
    url = F.concat(F.when(p % 7 == 1, "ftp://h/").otherwise("https://h/"), p.cast("string"))
    path = F.concat(F.when(p % 5 == 2, "../").otherwise(""), F.lit("ad-cache/"), F.sha2(url.cast("binary"), 256), F.lit(".ts"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("long")
    sha = F.sha2(F.when(p % 6 == 5, F.lit(b"other")).otherwise(F.coalesce(html, F.lit(b""))), 256)
    content = F.when(p % 4 != 3, html)
    return table(spark, sf_dir, "pages").select("page_id", checks.cache_state(url, size, sha, path, content).alias("state"), checks.file_matches(content, size, F.upper(sha)).alias("intact"))


@query("""
    SELECT nation AS policy, bool_and(good) AND count(DISTINCT name) FILTER (name IN ('s0', 's1', 's2')) = 3 AS intact
    FROM (SELECT s_nationkey AS nation, 's' || (s_suppkey % 6) AS name, s_suppkey % 41 <> 0 AS good FROM supplier) GROUP BY nation
""")
def runtime_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-04"""
    name = F.concat(F.lit("s"), (F.col("s_suppkey") % 6).cast("string"))
    content = lambda n: F.concat(F.lit("content of "), n).cast("binary")
    supplier = table(spark, sf_dir, "supplier")
    expected = supplier.select(F.col("s_nationkey").alias("policy"), name.alias("name"), F.when(F.col("s_suppkey") % 41 == 0, F.sha2(F.lit(b"changed"), 256)).otherwise(F.sha2(content(name), 256)).alias("sha256"))
    actual = spark.range(6).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name")).withColumn("content", content(F.col("name")))
    return checks.assets_intact(expected, actual, "policy", ["s0", "s1", "s2"])


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN g = 0 AND s = 0 THEN sec = 0 AND same ELSE g BETWEEN 1 AND 4096 AND s > 0 AND sec > 0 END AND l_orderkey % 17 <> 0 AND l_orderkey % 19 <> 0 AS holds
    FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 2) * (l_partkey % 3) * 1025 AS g, l_suppkey % 3 AS s, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_orderkey % 11 END AS sec, l_partkey % 2 = 0 AS same FROM lineitem)
""")
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-22, SC-12"""
    o, p, s = (F.col(f"l_{n}key") for n in ("order", "part", "supp"))
    identity = F.when(o % 17 == 0, F.lit("no digest")).otherwise(F.sha2(o.cast("string").cast("binary"), 256))
    seconds = F.when(s % 3 == 0, 0.0).otherwise((o % 11).cast("double"))
    holds = checks.plan_holds(identity, (F.col("l_linenumber") - 2) * (p % 3) * 1025, s % 3, seconds, o % 19 != 0, p % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", holds.alias("holds"))


@query("""
    SELECT event_id, boot >= 0 AND boot = now_boot AND started >= 0 AND now BETWEEN started AND expires - 1 AND (expires - started) / 60000 IN (5, 10, 15, 20, 25, 30, 60) AS valid
    FROM (SELECT event_id, event_id % 4 - 1 AS boot, (event_id // 4) % 4 - 1 AS now_boot, (event_id % 13 - 1) * 60000 AS started, (event_id % 13 - 1) * 60000 + (event_id % 14) * 300000 AS expires, (event_id % 97) * 45000 AS now FROM events)
""")
def sharing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM-02"""
    e = F.col("event_id")
    started = (e % 13 - 1) * 60_000
    valid = checks.session_valid(started, started + e % 14 * 300_000, e % 4 - 1, e % 97 * 45_000, F.floor(e / 4) % 4 - 1)
    return table(spark, sf_dir, "events").select("event_id", valid.alias("valid"))


# Requests and jobs

_MIMES = ["video/mp4", "audio/mpeg", "image/png", None, "text/plain"]
_PAGES = ["https://h/{k}", "http://h", "ftp://h/x", "https://u@h/", None, "no page"]


@query(f"""
    SELECT o_orderkey, CASE WHEN image THEN NULL WHEN recorded THEN 'content://' || o_orderkey WHEN web THEN page END AS uri, CASE WHEN image THEN NULL WHEN recorded THEN false WHEN web THEN true END AS is_page FROM (
      SELECT o_orderkey, page, o_orderkey % 13 = 0 OR o_orderkey % 5 = 2 AS image, o_orderstatus = 'F' AND o_orderkey % 3 > 0 AND o_orderkey % 5 < 2 AS recorded, o_orderkey % 6 < 2 AS web FROM (SELECT *, {sql_cases("o_orderkey", _PAGES)} AS page FROM orders))
""")
def transcript_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10"""
    k = F.col("o_orderkey")
    rows = of_cases(spark, sf_dir, "orders", "o_orderkey", mime=_MIMES, page=_PAGES).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("QUEUED")
    found = checks.transcript_source(status, F.when(k % 13 == 0, "Image").otherwise("720p"), F.col("mime"), F.when(k % 3 > 0, F.concat(F.lit("content://"), k.cast("string"))), F.col("page"))
    return rows.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.uri", "f.is_page")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 's' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 'f1' WHEN o_orderkey % 4 = 2 THEN 's' || o_orderkey ELSE 's' || o_orderkey END AS url, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 END::INT AS index,
      CASE o_orderkey % 4 WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'image' ELSE 'best video' END ELSE 'as asked' END AS format, CASE o_orderkey % 4 WHEN 1 THEN 'Cookie=new,X=1' WHEN 2 THEN 'COOKIE=same,X=1' ELSE 'X=1,cookie=old' END AS headers FROM orders
""")
def download_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-15, PRJ-05"""
    k = F.col("o_orderkey")
    source = F.concat(F.lit("s"), k.cast("string"))
    kind = "struct<url:string,is_image:boolean,headers:map<string,string>>"
    one = lambda url, image, header, value: F.struct(url.alias("url"), image.alias("is_image"), F.create_map(F.lit(header), F.lit(value)).alias("headers"))
    chosen = F.when(k % 4 == 1, one(F.lit("f1"), k % 3 == 0, "Cookie", "new")).cast(kind)
    formats = F.when(k % 4 == 2, F.array(one(F.lit("zzz"), F.lit(False), "A", "b"), one(source, F.lit(False), "COOKIE", "same"))).otherwise(F.array()).cast(f"array<{kind}>")
    headers = F.create_map(F.lit("X"), F.lit("1"), F.lit("cookie"), F.lit("old"))
    plan = checks.download_plan(F.when(k % 4 == 0, "PAGE").otherwise("DIRECT"), source, (k % 5).cast("int"), chosen, formats, headers)
    out = table(spark, sf_dir, "orders").select("o_orderkey", plan.alias("p")).select("o_orderkey", "p.url", "p.index", "p.format", F.array_sort(F.map_entries("p.headers")).alias("h"))
    return out.select("o_orderkey", "url", "index", "format", F.array_join(F.transform("h", lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("headers"))


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'page' WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 2 = 0 AND event_id % 7 < 4 AND (event_id % 5 = 1 OR event_id % 11 < 5) THEN 'submitted' ELSE 'picker' END AS route,
      CASE WHEN event_id % 4 > 0 THEN 'L' || event_id % 3 END AS line, CASE WHEN event_id % 4 > 0 THEN least(event_id % 4, 2) END::INT AS urls, event_id % 4 > 0 AND event_id % 3 <> event_id % 2 AS still FROM events
""")
def share_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-29, AUX-24"""
    e = F.col("event_id")
    line = lambda x: F.concat(F.lit("L"), x.cast("string"))
    urls = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.lit(1), (e % 4).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", checks.share_route(e % 3 == 0, e % 5, e % 2 == 1, e % 7 < 4, e % 11 < 5).alias("route"), checks.select_all(line(e % 3), urls).alias("s"))
    left = checks.clear_line(F.col("s"), line(e % 2))
    return rows.select("event_id", "route", "s.line", F.size("s.urls").alias("urls"), left.isNotNull().alias("still")).withColumn("urls", F.when(F.col("line").isNotNull(), F.col("urls")))


@query(f"""
    WITH {TASKS_SQL}, f AS (SELECT *, (id % 6 = 0 AND status NOT IN ('DOWNLOADING')) OR (status IN ('COMPLETED', 'FAILED') AND p = 1) AS goes FROM (SELECT *, id % 6 = 0 AS deleted, CASE WHEN id % 40 = 0 THEN 1 WHEN id % 41 = 0 THEN 2 WHEN id % 43 = 0 THEN 3 END AS p FROM tasks)),
    q AS (SELECT queue, max(p) AS worst, max(p) FILTER (goes) IS NOT NULL AS moving, coalesce(min(position) FILTER (NOT goes AND p IS NOT NULL), min(position) FILTER (NOT goes AND status NOT IN ('COMPLETED', 'FAILED'))) AS target FROM f GROUP BY queue)
    SELECT id, ['NETWORK', 'SYSTEM', 'STORAGE'][CASE WHEN NOT moving THEN p WHEN goes THEN NULL WHEN position = target THEN worst ELSE p END] AS new_pause FROM f JOIN q USING (queue)
""")
def moved_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-10"""
    i = F.col("id")
    rows = tasks(spark, sf_dir).withColumns({"active": F.col("status") == "DOWNLOADING", "terminal": F.col("status").isin("COMPLETED", "FAILED"), "deleted": i % 6 == 0, "pause": F.when(i % 40 == 0, "NETWORK").when(i % 41 == 0, "SYSTEM").when(i % 43 == 0, "STORAGE")})
    return checks.moved_pause(rows, "queue", "position").select("id", "new_pause")


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 1 OR trim(t, ' ') = '' THEN 0 ELSE greatest(turn - 1, 0) END::BIGINT AS start, CASE WHEN turn % 3 = 1 THEN '' ELSE t END AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '  ' ELSE coalesce(text, '') END AS t FROM conversations)
""")
def resumed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08"""
    t = F.col("turn")
    prior = F.when(t % 3 == 0, F.lit(None)).when(t % 3 == 1, F.lit("a")).otherwise(F.lit("b"))
    job = checks.resumed_job(prior.cast("string"), F.lit("b"), t.cast("long") - 1, F.when(t % 5 == 4, "  ").otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", job.alias("j")).select("conv_id", "turn", F.col("j.start").cast("long").alias("start"), "j.text")


@query(f"""
    WITH {TASKS_SQL} SELECT id, CASE WHEN id % 9 NOT IN (1, 2, 3) THEN status END AS status, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN 2 ELSE 0 END::INT AS entries FROM tasks
""")
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SRC-04"""
    i = F.col("id")
    said = F.when(i % 9 == 1, i + 1).otherwise(i).cast("string")
    payload = F.when(i % 9 == 2, F.lit("{broken")).otherwise(F.concat(F.lit('{"id":'), said, F.lit(',"position":'), F.when(i % 9 == 3, i + 7).otherwise(i).cast("string"), F.lit(',"status":"'), F.col("status"), F.lit('"}')))
    record = checks.queue_record(payload, "id bigint, position bigint, status string", i, F.col("position"))
    history = checks.stored_list(pick(cases("[]", '[{"url":"a","at":1},{"url":"b","at":2}]', "[{", "null"), i % 4), "url:string,at:bigint")
    return tasks(spark, sf_dir).select("id", record["status"].alias("status"), F.size(history).alias("entries"))


# Pages and links

REELS = [
    ("https://www.instagram.com/reel/Ab_{k}/?x=1", "https://www.instagram.com/reel/Ab_{k}/"), ("https://l.facebook.com/l.php?u=https%3A%2F%2Finstagram.com%2Freels%2FQ-1%2F&h=x", "https://www.instagram.com/reel/Q-1/"),
    ("https://l.facebook.com/l.php?h=x", None), ("https://www.instagram.com/p/abc/", None), ("https://l.facebook.com/l.php?u=%ZZ", None), ("", None),
]
ASSETS = [("https://static.cdn.example/a.js", True), ("https://S{k}.example/static.x/a.jpg", False), ("https://h/rsrc.php/v3/a.png", True), ("https://STATIC.xx.example", True), ("static.x/a", False)]
THUMBS = [("abc-{k}_1", "https://i.example/file/abc-{k}_1"), ("https://x.img.example.com/{k}.jpg", "https://x.img.example.com/{k}.jpg"), ("http://x.img.example.com/a.jpg", None), ("https://x.other.com/a.jpg", None), ("https://x.img.example.com:444/a", None), (None, None)]
LITERALS = [
    ('"a\\u0041\\n{k}"', "aA\n{k}"), ("'it\\'s \\x41\\u0042\\/'", "it's AB/"), ("'bad \\q'", None), ("'cut \\u00'", None), ('"open', None), ("'plain {k}'", "plain {k}"), ("'\\\\\\\\'", "\\\\"),
]


@query(f"""
    SELECT page_id, {sql_cases("page_id", [x[1] for x in REELS])} AS reel, {sql_cases("page_id", [x[1] for x in ASSETS], "BOOLEAN")} AS static, {sql_cases("page_id", [x[1] for x in THUMBS])} AS thumbnail, {sql_cases("page_id", [x[1] for x in LITERALS])} AS literal,
      'ThreadsVideo_c' || CASE WHEN page_id % 3 > 1 THEN '_' || (page_id % 5 + 1) ELSE '' END AS name FROM pages
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-15, AUX-16, STR-14"""
    p = F.col("page_id")
    rows = of_cases(spark, sf_dir, "pages", "page_id", link=[x[0] for x in REELS], asset=[x[0] for x in ASSETS], thumb=[x[0] for x in THUMBS], literal=[x[0] for x in LITERALS])
    return rows.select(
        "page_id", checks.reel_url(F.col("link")).alias("reel"), checks.static_asset(F.col("asset")).alias("static"), checks.thumbnail(F.col("thumb"), "https://i.example/file/", ".img.example.com").alias("thumbnail"),
        udfs.script_literal("literal").alias("literal"), checks.video_name(F.lit("c"), p % 5, p % 3).alias("name"),
    )


# Sound and pictures


@query("""
    SELECT event_id, CASE WHEN event_id % 5 = 0 OR (event_id % 3 <> 0 AND e <= s) THEN NULL ELSE '-ss ' || (s // 1000) || '.' || lpad((s % 1000)::VARCHAR, 3, '0') || CASE WHEN event_id % 3 = 0 THEN ' -fs 19200001' ELSE ' -t ' || ((e - s) // 1000) || '.' || lpad(((e - s) % 1000)::VARCHAR, 3, '0') END END AS range
    FROM (SELECT event_id, event_id * 37 % 100000 AS s, event_id * 91 % 100000 AS e FROM events)
""")
def audio_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-11"""
    e = F.col("event_id")
    args = checks.audio_arguments(F.lit("in"), F.when(e % 5 == 0, "in").otherwise("out"), e * 37 % 100_000, F.when(e % 3 != 0, e * 91 % 100_000))
    at = lambda a, x: F.get(a, F.array_position(a, x).cast("int"))
    told = F.concat(F.lit("-ss "), at(F.col("a"), F.lit("-ss")), F.when(e % 3 == 0, F.concat(F.lit(" -fs "), at(F.col("a"), F.lit("-fs")))).otherwise(F.concat(F.lit(" -t "), at(F.col("a"), F.lit("-t")))))
    return table(spark, sf_dir, "events").select("event_id", args.alias("a")).select("event_id", told.alias("range"))


@query("""
    WITH s AS (SELECT event_id, list_transform(range((event_id % 7)::BIGINT), lambda i: CASE WHEN (event_id * 31 + i * 7919) % 65536 >= 32768 THEN (event_id * 31 + i * 7919) % 65536 - 65536 ELSE (event_id * 31 + i * 7919) % 65536 END / 32768.0) AS x, (event_id % 3)::BIGINT AS c, [8000, 16000, 24000, 0][event_id % 4 + 1] AS rate FROM events),
    m AS (SELECT event_id, rate, len(x) AS n, list_transform(range(len(x) // greatest(c, 1)), lambda i: list_sum(x[i * greatest(c, 1) + 1:(i + 1) * greatest(c, 1)]) / greatest(c, 1)) AS x FROM s),
    r AS (SELECT event_id, n, x, CASE WHEN rate IN (0, 16000) OR len(x) = 0 THEN x ELSE list_transform(range(greatest(floor(len(x) * (16000.0 / rate)), 1)::BIGINT), lambda i: x[least(floor(i / (16000.0 / rate)), len(x) - 1)::BIGINT + 1] * (1 - (i / (16000.0 / rate) - floor(i / (16000.0 / rate)))) + x[least(floor(i / (16000.0 / rate)) + 1, len(x) - 1)::BIGINT + 1] * (i / (16000.0 / rate) - floor(i / (16000.0 / rate)))) END AS y FROM m)
    SELECT event_id, CASE WHEN event_id % 6 <> 5 THEN n END::INT AS samples, CASE WHEN event_id % 6 <> 5 THEN len(y) END::INT AS resampled, CASE WHEN event_id % 6 <> 5 THEN round(coalesce(list_sum(y), 0), 6) END AS total FROM r
""")
def pcm_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22, NUM-04"""
    e = F.col("event_id")
    word = lambda i: (e * 31 + i * 7919) % 65536
    one = lambda x: F.lpad(F.hex(x), 2, "0")
    raw = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(6)), F.lit(1), (e % 7).cast("int")), lambda i: F.concat(one(word(i) % 256), one(F.floor(word(i) / 256)))), "")
    content = F.unhex(F.concat(raw, F.when(e % 6 == 5, "00").otherwise("")))
    rows = table(spark, sf_dir, "events").select("event_id", checks.pcm_samples(content, 100).alias("s"))
    rows = rows.withColumn("y", checks.resampled(checks.mono(F.col("s"), (e % 3).cast("int")), pick(cases(8000, 16000, 24000, 0), e % 4)))
    whole = F.col("s").isNotNull()
    return rows.select("event_id", F.when(whole, F.size("s")).alias("samples"), F.when(whole, F.size("y")).alias("resampled"), F.when(whole, r6(F.aggregate("y", F.lit(0.0), lambda a, x: a + x))).alias("total"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 5 = 0 THEN NULL ELSE 2 END ELSE event_id % 3 END::INT AS samples, ['ok', 'malformed', 'malformed', 'incomplete', 'malformed', 'invalid', 'invalid', 'invalid'][event_id % 8 + 1] AS png FROM events
""")
def decoded_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-10, AUX-08"""
    e = F.col("event_id")
    primary = F.when(e % 3 == 0, F.when(e % 2 == 0, F.array().cast("array<double>"))).otherwise(F.array_repeat(F.lit(0.5), (e % 3).cast("int")))
    samples = checks.decoded(primary, F.when(e % 5 != 0, F.array(F.lit(0.1), F.lit(0.2))))
    chunk = lambda kind, body: F.concat(F.lpad(F.hex(F.length(F.lit(body)) / 2), 8, "0"), F.lit(kind + body), F.lpad(F.hex(F.crc32(F.unhex(F.lit(kind + body)))), 8, "0"))
    size = "0000000200000003"
    begin = F.concat(F.lit("89504E470D0A1A0A"), chunk("49484452", size + "0802000000"))
    image, end = chunk("49444154", "0102{}".format("FF")), chunk("49454E44", "")
    good = F.concat(begin, image, end)
    zero = F.concat(F.lit("89504E470D0A1A0A"), chunk("49484452", "0000000000000003" + "0802000000"), image, end)
    broken = F.concat(begin, F.overlay(image, F.lit("AA"), 17), end)
    pngs = F.array(good, broken, F.concat(good, F.lit("00")), F.concat(begin, image), F.concat(begin, end), F.lit("0011"), zero, F.lit(""))
    rows = table(spark, sf_dir, "events").select("event_id", samples.alias("s"), F.unhex(pick(pngs, e % 8)).alias("p"))
    return rows.select("event_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("samples"), udfs.png_state("p").alias("png"))


LAYOUTS = [
    ("今天天氣很好。我們出去走走吧！", "今天天氣很好。\n我們出去走走吧！"), ("他說「我來了」。然後就走了。", "他說「我來了」。\n然後就走了。"), ("真的嗎？！太好了。", "真的嗎？！\n太好了。"), ("圓周率約 3.14 而已", "圓周率約 3.14 而已"),
    ("版本 v1.2.3 發佈", "版本 v1.2.3 發佈"), ("到 example.com 看看", "到 example.com 看看"), ("Hello world. How are you?", "Hello world.\nHow are you?"), ("   \n  ", ""), ("好。   走吧。", "好。\n走吧。"), ("a；b", "a；\nb"),
    ("x" * 50, "x" * 42 + "\n" + "x" * 8), ("a" * 20 + "," + "b" * 30, "a" * 20 + ",\n" + "b" * 30), ("中" * 13 + "z" * 40, "中" * 13 + "\n" + "z" * 40), (None, None),
]


@query(f"SELECT doc_id, {sql_cases('doc_id', [x[1] for x in LAYOUTS])} AS lines FROM documents")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20"""
    return of_cases(spark, sf_dir, "documents", "doc_id", text=[x[0] for x in LAYOUTS]).select("doc_id", udfs.break_lines("text").alias("lines"))


SAID = [
    ("Ｒegister now at Win . EXAMPLE.com!", "win.example.com", "register", ""), ("Starring A. Person", "a.person", "", "starring"), ("博彩 充值 bonus", "", "bonus,充值,博彩", ""), ("Tradução e elenco", "", "", "elenco,tradução"),
    ("betting-free alphabet", "", "betting", ""), ("x.example.org and y.example.org", "x.example.org,y.example.org", "", ""), (None, "", "", ""), ("directed   by no one", "", "", "directed   by"),
]
#: Words that promote, and words of a programme's own credits (fixed values).
PROMOTES = r"\b(?:register|registration|deposit|gambling|casino|betting|bet|bonus|rebate|signup)\b|棋牌|博彩|註冊|注册|充值|投注|返利|賭場|赌场"
CREDITS = r"(?U)\b(?:elenco|cast|tradução|traducao|starring|screenplay|directed\s+by)\b|配音|演員|演员|字幕製作|字幕制作"
DOMAIN = r"(?<![\w.-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:[a-z]{2,24})(?![\w.-])"
CONFIDENT = 0.8


def words_of(text: Column, pattern: str) -> Column:
    """The different matches of a pattern, sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))))


@query(f"""
    SELECT doc_id, CASE WHEN sure THEN domains ELSE '' END AS domains, CASE WHEN sure THEN promotes ELSE '' END AS promotes, CASE WHEN sure THEN credits ELSE '' END AS credits, CASE WHEN sure AND domains || promotes || credits <> '' AND doc_id % 3 > 0 THEN round((doc_id % 3) * 0.02, 6) END AS area
    FROM (SELECT doc_id, doc_id % 10 >= 8 AS sure, {sql_cases("doc_id", [x[1] for x in SAID])} AS domains, {sql_cases("doc_id", [x[2] for x in SAID])} AS promotes, {sql_cases("doc_id", [x[3] for x in SAID])} AS credits FROM documents)
""")
def matched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-07, STR-29, STR-17"""
    rows = of_cases(spark, sf_dir, "documents", "doc_id", text=[x[0] for x in SAID]).withColumn("plain", F.when((F.col("doc_id") % 10) / 10.0 >= CONFIDENT, udfs.fold_text("text")))
    found = rows.select("doc_id", *(F.array_join(words_of(F.col("plain"), p), ",").alias(n) for n, p in (("domains", DOMAIN), ("promotes", PROMOTES), ("credits", CREDITS))))
    box = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit(0.0), F.lit(0.0), (F.col("doc_id") % 3) * 0.1, F.lit(0.2)))
    return found.withColumn("area", F.when(F.concat("domains", "promotes", "credits") != "", r6(box[2] * box[3])))


# Evidence of the first version's decision

#: Bounds of that decision (fixed values).
LEAST_NATIVE, JOIN_FACTOR, JOIN_FLOOR, SEAM_FACTOR, SEAM_JOIN_FLOOR, SEAM_FLOOR = 1 / 255, 4, 2 / 255, 4, 1 / 255, 4 / 255
FLAT, GAIN_DB, DISTINCT_TIMES = 0.35, 6.0, 2


def bridge_status(start: Column, end: Column, joined: Column, sides: list[Column], cut_out: Column) -> Column:
    """strong where what stands before and behind fits together better than it fits the candidate, else unknown."""
    known = start.isNotNull() & end.isNotNull() & joined.isNotNull() & sides[0].isNotNull() & sides[1].isNotNull()
    base = F.greatest(*sides)
    fits = joined <= F.greatest(JOIN_FACTOR * base, F.lit(JOIN_FLOOR))
    seam = F.least(start, end) >= F.greatest(SEAM_FACTOR * F.greatest(joined, F.lit(SEAM_JOIN_FLOOR)), F.lit(SEAM_FLOOR))
    return F.when(cut_out & known & (base >= LEAST_NATIVE) & fits & seam, "strong").otherwise("unknown")


def promotion_status(inside: DataFrame, outside: DataFrame, key: str) -> DataFrame:
    """(key, promotion, contradicted): strong where a domain at two times or more, seen nowhere outside, goes with a promoting word.

    ``inside`` and ``outside`` have key, time, domains, promotes and credits (arrays); keys without reliable text are not in them.
    """
    seen = inside.select(key, "time", F.explode("domains").alias("domain")).groupBy(key, "domain").agg(F.count_distinct("time").alias("times")).where(F.col("times") >= DISTINCT_TIMES)
    known = outside.select(key, F.explode("domains").alias("domain")).distinct()
    new = seen.join(known, [key, "domain"], "left_anti").select(key, F.lit(True).alias("new")).distinct()
    words = inside.groupBy(key).agg(F.max(F.size("promotes") > 0).alias("promoted"), F.max(F.size("credits") > 0).alias("contradicted"))
    return words.join(new, key, "left").select(key, F.when(F.col("new") & F.col("promoted"), "strong").otherwise("unknown").alias("promotion"), "contradicted")


def style_status(flat: Column, own: Column, sides: list[Column]) -> Column:
    """strong where one colour fills the picture and the sound is louder than both sides; it has no vote."""
    louder = [F.coalesce((own > 0) & (side > 0) & (20 * F.log10(own / side) >= GAIN_DB), F.lit(False)) for side in sides]
    return F.when(F.coalesce(flat >= FLAT, F.lit(False)) & louder[0] & louder[1], "strong").otherwise("unknown")


def decision(bridge: Column, promotion: Column, contradicted: Column, valid: Column) -> Column:
    strong = valid & (bridge == "strong") & (promotion == "strong")
    return F.when(contradicted, "retain_programme").when(strong, "experimental_ad_candidate").otherwise("unknown")


@query("""
    WITH e AS (SELECT event_id, (event_id % 40) / 255.0 AS st, (event_id % 37) / 255.0 AS en, (event_id % 11) / 255.0 AS jo, CASE WHEN event_id % 9 > 0 THEN (event_id % 5) / 510.0 END AS lo, (event_id % 7) / 510.0 AS hi, event_id % 8 > 0 AS cut, (event_id % 10) / 10.0 AS flat, (event_id % 50)::DOUBLE AS own, (event_id % 13)::DOUBLE AS a, (event_id % 6)::DOUBLE AS b FROM events)
    SELECT event_id, CASE WHEN cut AND lo IS NOT NULL AND greatest(lo, hi) >= 1 / 255.0 AND jo <= greatest(4 * greatest(lo, hi), 2 / 255.0) AND least(st, en) >= greatest(4 * greatest(jo, 1 / 255.0), 4 / 255.0) THEN 'strong' ELSE 'unknown' END AS bridge,
      CASE WHEN flat >= 0.35 AND CASE WHEN own > 0 AND a > 0 THEN 20 * log10(own / a) >= 6 ELSE false END AND CASE WHEN own > 0 AND b > 0 THEN 20 * log10(own / b) >= 6 ELSE false END THEN 'strong' ELSE 'unknown' END AS style FROM e
""")
def bridge_and_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-08, SC-10"""
    e = F.col("event_id")
    sides = [F.when(e % 9 > 0, (e % 5) / 510.0), (e % 7) / 510.0]
    bridge = bridge_status((e % 40) / 255.0, (e % 37) / 255.0, (e % 11) / 255.0, sides, e % 8 > 0)
    sound = [(e % 13).cast("double"), (e % 6).cast("double")]
    return table(spark, sf_dir, "events").select("event_id", bridge.alias("bridge"), style_status((e % 10) / 10.0, (e % 50).cast("double"), sound).alias("style"))


@query("""
    WITH i AS (SELECT l_orderkey AS k, l_linenumber AS t, 'd' || (l_partkey % 3) AS d, l_suppkey % 3 = 0 AS promo, l_suppkey % 29 = 0 AS credit FROM lineitem WHERE l_linenumber <= 4),
    o AS (SELECT DISTINCT l_orderkey AS k, 'd' || (l_partkey % 3) AS d FROM lineitem WHERE l_linenumber > 4),
    n AS (SELECT DISTINCT k FROM (SELECT k, d FROM i GROUP BY k, d HAVING count(DISTINCT t) >= 2) WHERE (k, d) NOT IN (SELECT (k, d) FROM o))
    SELECT k AS l_orderkey, CASE WHEN bool_or(promo) AND k IN (SELECT k FROM n) THEN 'strong' ELSE 'unknown' END AS promotion, CASE WHEN bool_or(credit) THEN 'retain_programme' WHEN k % 5 > 0 AND bool_or(promo) AND k IN (SELECT k FROM n) THEN 'experimental_ad_candidate' ELSE 'unknown' END AS decision FROM i GROUP BY k
""")
def promotion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-09, SC-10"""
    words = lambda c, w: F.when(c, F.array(F.lit(w))).otherwise(F.array().cast("array<string>"))
    domain = F.array(F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("time"), domain.alias("domains"), words(F.col("l_suppkey") % 3 == 0, "bonus").alias("promotes"), words(F.col("l_suppkey") % 29 == 0, "cast").alias("credits"))
    found = promotion_status(rows.where("time <= 4"), rows.where("time > 4"), "l_orderkey")
    k = F.col("l_orderkey")
    judged = decision(F.when(k % 5 > 0, "strong").otherwise("unknown"), F.col("promotion"), F.col("contradicted"), F.lit(True))
    return found.select("l_orderkey", "promotion", judged.alias("decision"))


def coverage(candidates: DataFrame, key: str) -> DataFrame:
    """Counters of a plan's work from its candidates: status (scored, unknown or null if not looked at), skipped_ocr, ocr_failures, absent."""
    looked = F.col("status").isNotNull()
    failures = F.coalesce(F.sum("ocr_failures"), F.lit(0))
    counts = candidates.groupBy(key).agg(
        F.count("*").alias("eligible"), F.count_if(looked).alias("scanned"), F.count_if(~looked).alias("unscanned"), F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if(F.col("status") == "scored").alias("valid"),
        F.count_if(looked & F.col("skipped_ocr")).alias("skipped_ocr"), failures.alias("ocr_failures"), F.coalesce(F.sum("absent"), F.lit(0)).alias("absent"),
    )
    whole = (F.col("unscanned") == 0) & (F.col("unknown") == 0)
    return counts.withColumns({"decoded": whole, "analysed": whole & (F.col("ocr_failures") == 0), "evidence": whole & (F.col("ocr_failures") == 0) & (F.col("skipped_ocr") == 0)})


@query("""
    SELECT l_orderkey, count(*) AS eligible, count(s) AS scanned, count(*) - count(s) AS unscanned, count(*) FILTER (s = 'unknown') AS unknown, count(*) FILTER (s = 'scored') AS valid, count(*) FILTER (s IS NOT NULL AND o) AS skipped_ocr, sum(f)::BIGINT AS ocr_failures, sum(a)::BIGINT AS absent,
      bool_and(coalesce(s, '') = 'scored') AS decoded, bool_and(coalesce(s, '') = 'scored') AND sum(f) = 0 AS analysed, bool_and(coalesce(s, '') = 'scored') AND sum(f) = 0 AND count(*) FILTER (s IS NOT NULL AND o) = 0 AS evidence
    FROM (SELECT l_orderkey, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 8 = 0 THEN 'unknown' ELSE 'scored' END AS s, l_suppkey % 6 = 0 AS o, (l_suppkey % 10 = 0)::INT AS f, l_linenumber % 2 AS a FROM lineitem) GROUP BY l_orderkey
""")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14"""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    status = F.when(p % 9 == 0, F.lit(None)).when(p % 8 == 0, "unknown").otherwise("scored")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status"), (s % 6 == 0).alias("skipped_ocr"), (s % 10 == 0).cast("int").alias("ocr_failures"), (F.col("l_linenumber") % 2).alias("absent"))
    return coverage(rows, "l_orderkey")
