"""Registered queries for media metadata, choices and file rules, over inputs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import features, queue
from ..registry import query
from ..sources import media, products, reports
from .catalogue import r6, table


def cases(*values: object) -> Column:
    """An array of literals to pick from by index."""
    return F.array(*map(F.lit, values))


def pick(values: Column, index: Column) -> Column:
    return F.element_at(values, (index + 1).cast("int"))


# Sources

INFO = """{"id":"v%d","title":"T%d","duration":12.5,"formats":[{"format_id":"a","ext":"MP4","vcodec":"h264","acodec":"none","height":%d,"filesize":100},{"format_id":"b","ext":"m4a","vcodec":"none","acodec":"aac"},{"ext":"mp4","vcodec":"x"},{"format_id":"s","ext":"mhtml"}]}"""


@query("""
    SELECT o_orderkey, f, CASE f WHEN 'a' THEN h || 'p mp4 (video only)' ELSE 'Audio m4a' END AS label, CASE f WHEN 'a' THEN 100 END::BIGINT AS bytes
    FROM (SELECT o_orderkey, (o_orderkey % 5 + 1) * 180 AS h, unnest(['a', 'b']) AS f FROM orders)
""")
def info_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, PRJ-01, PRJ-02, PRJ-04"""
    k = F.col("o_orderkey")
    info = F.format_string(INFO, k, k, (k % 5 + 1) * 180)
    items = media.media_items(table(spark, sf_dir, "orders").select("o_orderkey", info.alias("info")), "o_orderkey", "info")
    return items.select("o_orderkey", F.explode("formats").alias("f")).select("o_orderkey", F.col("f.format_id").alias("f"), F.col("f.label").alias("label"), F.col("f.bytes").alias("bytes"))


@query("""
    SELECT c_custkey, i AS position, 'e' || i AS id, CASE WHEN i = 2 THEN 'jpg' ELSE 'mp4' END AS ext, i = 2 AS is_image
    FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [1, 2] ELSE [1, 2, 4] END) AS i FROM customer)
""")
def info_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, PRJ-02, PRJ-03"""
    parts = '{"id":"e1","url":"http://x/a.mp4?t=1"},{"id":"e2","url":"http://x/b.jpg"},{"id":"e3"}'
    info = F.when(F.col("c_custkey") % 2 == 0, F.lit('{"entries":[%s]}' % parts)).otherwise(F.lit('{"entries":[%s,{"id":"e4","url":"http://x/c"}]}' % parts))
    items = media.media_items(table(spark, sf_dir, "customer").select("c_custkey", info.alias("info")), "c_custkey", "info")
    return items.select("c_custkey", "position", "id", F.col("formats")[0]["ext"].alias("ext"), "is_image")


@query("""
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'PROCESSING' WHEN event_id % 4 < 3 THEN 'DOWNLOADING' END AS phase,
      CASE WHEN event_id % 4 = 1 THEN round(least(1.0, event_id / 5000), 6) WHEN event_id % 4 = 2 THEN -1.0 END AS fraction FROM events
""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, NUM-06"""
    e = F.col("event_id")
    line = (
        F.when(e % 4 == 0, F.lit('progress:{"status":"finished"}'))
        .when(e % 4 == 1, F.format_string(' progress:{"status":"downloading","downloaded_bytes":%d,"total_bytes":5000}', e))
        .when(e % 4 == 2, F.lit('progress:{"status":"downloading","downloaded_bytes":-1,"total_bytes":0}'))
        .otherwise(F.lit("progress:{broken"))
    )
    p = media.progress(line)
    return table(spark, sf_dir, "events").select("event_id", p["phase"].alias("phase"), r6(p["fraction"]).alias("fraction"))


@query("""
    SELECT l_orderkey, l_linestatus, count(*) AS words, min(l_partkey) AS "left", min(l_suppkey) AS top, max(l_partkey + l_linenumber) - min(l_partkey) AS width, min(l_discount) AS confidence
    FROM lineitem WHERE l_discount >= 0.02 GROUP BY ALL
""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23, AGG-17"""
    words = table(spark, sf_dir, "lineitem").withColumn("confidence", F.when(F.col("l_discount") >= 0.02, F.col("l_discount")).otherwise(-1.0))
    out = media.word_lines(words, ["l_orderkey", "l_linestatus"], "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_linenumber", "l_linenumber", "confidence")
    return out.select("l_orderkey", "l_linestatus", F.size(F.split("text", " ")).cast("long").alias("words"), "left", "top", "width", "confidence")


@query("""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://a.b/x/e' WHEN 1 THEN 'https://a.b/d' WHEN 2 THEN 'https://c.d/' WHEN 3 THEN 'https://a.b/x/y?q=1' ELSE 'https://e.f/g' END AS url, '+A é' AS plain FROM pages
""")
def script_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12, STR-13"""
    link = pick(cases("e", "../d", "https://c.d/", "?q=1", "//e.f/g"), F.col("page_id") % 5)
    return table(spark, sf_dir, "pages").select("page_id", udfs.resolve_url(F.lit("https://a.b/x/y"), link).alias("url"), udfs.unescape_script(F.lit("+%41%20%u00e9")).alias("plain"))


@query("""SELECT event_id, '{"a":' || event_id || ',"b":[1,{"c":"}"}]}' AS canonical, sha256('{"a":' || event_id || ',"b":[1,{"c":"}"}]}') AS digest FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15, STR-30"""
    script = F.format_string('var player = {"b": [1, {"c": "}"}], "a": %d}; more {', F.col("event_id"))
    canonical = udfs.canonical_json(udfs.json_object_at(script, F.instr(script, "{") - 1))
    return table(spark, sf_dir, "events").select("event_id", canonical.alias("canonical")).withColumn("digest", F.sha2("canonical", 256))


# Projections and choices


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '-x --audio-format mp3 -f ba/b' WHEN o_orderkey % 3 = 0 THEN '-f bv*+ba/b'
      ELSE '-f bv*[height<=' || (o_orderkey % 4) * 360 || ']+ba/b[height<=' || (o_orderkey % 4) * 360 || ']/bv*+ba/b -S res:' || (o_orderkey % 4) * 360 END AS arguments FROM orders
""")
def download_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-13, PRJ-14"""
    k = F.col("o_orderkey")
    cap = F.when(k % 3 != 0, k % 4 * 360)
    kind = media.default_choice(k % 7 == 0, k % 5 == 0, cap)
    made = media.format_arguments(kind, cap, F.lit("mp3"), F.lit(None).cast("string"), F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(made, " ").alias("arguments"))


@query("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'audio/flac' ELSE 'application/octet-stream' END AS mime,
      CASE c_custkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' END AS kind FROM customer
""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26, AUX-14"""
    k = F.col("c_custkey") % 4
    url = F.concat(F.lit("https://h/p.q/f."), pick(cases("MP4", "jpeg", "flac", "zip"), k), F.lit("?x=.gif#y.png"))
    head = F.unhex(pick(cases("89504E470D0A1A0A00000000", "FFD8FFE0", "524946460000000057454250", "00"), k))
    return table(spark, sf_dir, "customer").select("c_custkey", media.mime_type(media.extension(url)).alias("mime"), media.image_kind(head).alias("kind"))


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1500000 WHEN 1 THEN 500 WHEN 5 THEN 1000 END::BIGINT AS rate FROM part
""")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-25, AUX-18"""
    k = F.col("p_partkey") % 6
    amount, unit = pick(cases("1,5", ".5", "0.0001", "0", "x1", "1."), k), pick(cases(1000000, 1000, 1000, 1000, 1000, 1000), k)
    return table(spark, sf_dir, "part").select("p_partkey", media.rate(amount, unit).alias("rate"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'pt' END AS code, p_partkey % 2 = 0 AS han FROM part")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21, STR-22, AUX-27"""
    code = media.language_code(pick(cases("<|yue|>", "EN", "pt-BR"), F.col("p_partkey") % 3))
    han = F.rlike(pick(cases("字 a", "kana かな"), F.col("p_partkey") % 2), F.lit(r"\p{IsHan}"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), han.alias("han"))


@query("""
    SELECT user_id, event_id, 'Post' || CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) > 1 THEN ' ' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) ELSE '' END AS title FROM events
""")
def numbered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-19, AUX-30"""
    w = W.partitionBy("user_id", "event_type")
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy("event_id"))
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", F.concat(F.lit("Post"), F.when(n > 1, F.concat(F.lit(" "), at.cast("string"))).otherwise("")).alias("title"))


# Orders and limits


@query("""
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY n IS NULL, n, event_id) AS rank FROM (
      SELECT user_id, event_id, CASE WHEN event_id % 9 > 0 THEN event_id % 9 END AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 9 = 0, event_id % 9, event_id) AS twin FROM events) WHERE twin = 1
""")
def episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01, SET-05"""
    n = F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 9)
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct(n.isNull().alias("no"), F.coalesce(n, F.lit(0)).alias("n"), "event_id")).alias("e"))
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("e"))
    return first.select("user_id", F.col("e.event_id").alias("event_id"), rank.cast("long").alias("rank"))


_CODECS, _LANGS, _ENDS = ("h.264", "HEVC", "", "avc1", "vp9"), ("en-US", "ja", "zh-TW", "fr", "", "ko", "zh"), ("mp4", "webm", "part", "m4a", "jpg", "opus")
_listed = lambda values, n: f"[{', '.join(repr(v) for v in values)}][({n} % {len(values)} + 1)::INT]"


@query(f"""
    WITH items AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_partkey AS p, {_listed(_CODECS, "l_partkey")} AS codec, (l_suppkey % 5 - 1) * 100 AS w, (l_partkey % 3) * 50 AS h,
      {_listed(_LANGS, "l_suppkey")} AS lang, {_listed(_ENDS, "l_partkey")} AS ending, (l_quantity * 100)::BIGINT AS size FROM lineitem),
    named AS (SELECT *, 'media.' || CASE WHEN lang = '' THEN '' ELSE lang || '.' END || 'vtt' AS cap, CASE WHEN p % 7 = 2 THEN 'other.' WHEN p % 7 = 4 THEN 'media.x-Frag1.' ELSE 'media.' END || ending AS file,
      CASE lower(codec) WHEN 'h.264' THEN 2 WHEN 'avc1' THEN 2 WHEN 'hevc' THEN 0 ELSE 1 END AS rank, CASE lang WHEN 'zh-TW' THEN 1 WHEN 'zh' THEN 3 WHEN 'en-US' THEN 6 WHEN 'ja' THEN 7 WHEN 'ko' THEN 8 WHEN 'fr' THEN 9 ELSE 3 END AS place FROM items)
    SELECT l_orderkey, arg_max('u' || p, (rank, greatest(w, 0) * greatest(h, 0), h, -i)) AS best, arg_min(cap, (CASE WHEN lang = '' THEN 99 ELSE place END, i)) AS caption,
      coalesce(CASE l_orderkey % 3 WHEN 0 THEN coalesce(arg_min(file, i) FILTER (ok AND ending = 'opus'), arg_min(file, i) FILTER (ok AND ending IN ('m4a', 'opus'))) WHEN 1 THEN arg_min(file, i) FILTER (ok AND ending = 'jpg') END, arg_max(file, (size, -i)) FILTER (ok)) AS output
    FROM (SELECT *, file LIKE 'media.%' AND file NOT LIKE '%-Frag%' AND ending <> 'part' AS ok FROM named) GROUP BY l_orderkey
""")
def best_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06, SRT-07, SRT-09"""
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    chosen = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    lang, ending = chosen(_LANGS, supp), chosen(_ENDS, part)
    form = F.struct(F.concat(F.lit("u"), part.cast("string")).alias("url"), ((supp % 5 - 1) * 100).cast("int").alias("width"), (part % 3 * 50).cast("int").alias("height"), F.lit(None).cast("string").alias("size"), chosen(_CODECS, part).alias("codec"))
    cap = F.concat(F.lit("media."), F.when(lang == "", "").otherwise(F.concat(lang, F.lit("."))), F.lit("vtt"))
    file = F.struct(F.concat(F.when(part % 7 == 2, "other.").when(part % 7 == 4, "media.x-Frag1.").otherwise("media."), ending).alias("name"), (F.col("l_quantity") * 100).cast("long").alias("size"))
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(own)).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", form.alias("form"), cap.alias("cap"), file.alias("file")))).alias("x"))
    of = lambda n: F.transform("x", lambda r: r[n])
    kind = F.when(F.col("l_orderkey") % 3 == 0, "AUDIO").when(F.col("l_orderkey") % 3 == 1, "IMAGE").otherwise("BEST")
    return rows.select("l_orderkey", products.best_video(of("form"))["url"].alias("best"), products.caption_file(of("cap")).alias("caption"), products.output_file(of("file"), kind, F.lit("OPUS")).alias("output"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 3000")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-10"""
    used = F.sum(F.octet_length("text") + 1).over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("used", used).where("used <= 3000").select("conv_id", "turn")


@query("""
    SELECT split_part(substr(path, 2), '/', 1) AS child, max(strpos(substr(path, 2), '/')) > 0 AS folder, count(*) AS files FROM (SELECT regexp_replace(url, '^https?:/', '') AS path FROM pages) WHERE NOT regexp_matches(path, '(^|/)[.]|[.](part|tmp|ytdl)$') GROUP BY 1
""")
def shared_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, PRJ-11, AUX-21"""
    path = F.regexp_replace("url", "^https?:/", "")
    rows = table(spark, sf_dir, "pages").select(path.alias("path")).where(~F.rlike("path", F.lit(r"(^|/)[.]|[.](part|tmp|ytdl)$")))
    below = F.substr("path", F.lit(2))
    return rows.groupBy(F.substring_index(below, "/", 1).alias("child")).agg(F.max(F.instr(below, "/") > 0).alias("folder"), F.count("*").alias("files"))


@query("SELECT page_id, url AS path, length(html)::BIGINT AS size FROM pages WHERE url LIKE 'http://t%' AND page_id % 7 <> 3 AND page_id > 20")
def shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, SNK-03: the predicate goes down to the published parts"""
    folder = reports.new_folder(spark, "listing")
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 7 == 3).cast("int").alias("pending"))
    reports.publish(rows, folder)
    found = reports.published(spark, folder).where("path LIKE 'http://t%' AND pending = 0 AND page_id > 20")
    return found.orderBy("page_id").select("page_id", "path", "size")


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 10 OFFSET 5")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08"""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return rows.orderBy(F.lower("c_name"), "c_custkey").offset(5).limit(10)


@query("SELECT c_custkey, [1, 3] AS kept, CASE WHEN c_custkey % 2 = 0 THEN [1] ELSE [1, 2, 3] END AS toggled FROM customer")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02, SET-03, JN-10"""
    chosen, offered = cases(1, 9, 3), cases(1, 2, 3)
    item = F.when(F.col("c_custkey") % 2 == 0, 3).otherwise(2)
    toggled = F.array_sort(queue.selection_toggle(chosen, offered, item))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_intersect(chosen, offered).alias("kept"), toggled.alias("toggled"))


@query("""
    SELECT d.user_id, min(k) AS free FROM (SELECT DISTINCT user_id FROM events) d, range(1, 50) t(k)
    WHERE NOT EXISTS (SELECT 1 FROM events u WHERE u.event_id % 40 = k AND u.user_id = d.user_id) GROUP BY d.user_id
""")
def free_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-26: the least number that a folder does not use lies directly after one that it uses, or is 1"""
    used = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("n")).where("n > 0").distinct()
    w = W.partitionBy("user_id").orderBy("n")
    gap = used.withColumns({"row": F.row_number().over(w)}).where("n = row").groupBy("user_id").agg((F.max("n") + 1).alias("free"))
    return table(spark, sf_dir, "events").select("user_id").distinct().join(gap, "user_id", "left").select("user_id", F.coalesce("free", F.lit(1)).alias("free"))


# Checks


@query("SELECT user_id, bool_and(coalesce(event_id > before, true)) AS increasing, count(*) FILTER (value <= v) AS stalls FROM (SELECT *, lag(event_id) OVER w AS before, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def packet_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13, STM-05, AUX-03"""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumns({"before": F.lag("event_id").over(w), "v": F.lag("value").over(w)})
    return rows.groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("event_id") > F.col("before"), F.lit(True))).alias("increasing"), F.count_if(F.col("value") <= F.col("v")).alias("stalls"))


@query("SELECT user_id, event_id, event_id - first(event_id) OVER w AS since, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14, WIN-19"""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") - F.first("event_id").over(w)).alias("since"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("SELECT l_orderkey, count(*) AS packets, min(l_shipdate) AS first, max(l_shipdate) AS last, date_diff('day', min(l_shipdate), max(l_shipdate)) <= 60 AS bounded FROM lineitem GROUP BY l_orderkey")
def stream_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20"""
    near = F.datediff(F.max("l_shipdate"), F.min("l_shipdate")) <= 60
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("packets"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), near.alias("bounded"))


@query("SELECT l_orderkey, list_sort(list(l_linenumber)) = range(1, count(*) + 1) AS complete, abs(sum(l_quantity) - (SELECT 0)) > 100 AS large FROM lineitem GROUP BY l_orderkey")
def partition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, ARR-01, SC-12"""
    numbers = F.sort_array(F.collect_list(F.col("l_linenumber").cast("long")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((numbers == F.sequence(F.lit(1).cast("long"), F.count("*"))).alias("complete"), (F.abs(F.sum("l_quantity")) > 100).alias("large"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber AS depth, min(l_partkey) AS start, min(l_partkey) + 500 AS stop, min(l_returnflag) AS category FROM lineitem GROUP BY ALL),
    e AS (SELECT l_orderkey, t AS lo, lead(t) OVER (PARTITION BY l_orderkey ORDER BY t) AS hi FROM (SELECT DISTINCT l_orderkey, unnest([start, stop]) AS t FROM s)),
    c AS (SELECT e.l_orderkey, lo, hi, max_by(category, depth) AS category FROM e JOIN s ON s.l_orderkey = e.l_orderkey AND start <= lo AND stop >= hi GROUP BY ALL)
    SELECT l_orderkey, category, sum(hi - lo)::BIGINT AS seconds FROM c GROUP BY ALL
""")
def exclusive_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15"""
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("depth")).agg(F.min("l_partkey").alias("start"), (F.min("l_partkey") + 500).alias("stop"), F.min("l_returnflag").alias("category"))
    return features.exclusive_time(spans, "l_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def retained_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02, JN-13"""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(items.where("l_quantity > 45"), "o_orderkey", "left_semi").join(items.where("l_returnflag = 'R'"), "o_orderkey", "left_anti")


def check_uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-03: keys that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03"""
    return check_uniqueness(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def tab_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03: every tab must find exactly one block"""
    blocks = table(spark, sf_dir, "region").groupBy("r_regionkey").agg(F.count("*").alias("n"), F.first("r_name").alias("r_name"))
    both = table(spark, sf_dir, "nation").join(blocks, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    name = F.when(F.col("n") == 1, F.col("r_name")).otherwise(F.raise_error(F.lit("a tab has no single block")).cast("string"))
    return both.select("n_nationkey", name.alias("r_name"))

