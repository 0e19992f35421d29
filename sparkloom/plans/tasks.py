"""Registered queries for playlists as text, captions, task rules, names and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import convert
from ..functions import text as T
from ..operators import features, queue, transcripts
from ..registry import query
from ..streaming import stateful
from . import scoring
from .catalogue import TASKS_SQL, r6, table, tasks
from .media import cases, pick


@query("SELECT conv_id, turn, role || ' says ' || turn AS value, 1::BIGINT AS lines FROM conversations")
def caption_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, WIN-15"""
    said = F.concat("role", F.lit(" says "), F.col("turn").cast("string"))
    vtt = F.concat(F.lit("WEBVTT\nLanguage: en\n\n1\n00:00.000 --> 00:01.000\n<b>"), said, F.lit("</b>\n\nNOTE x\n\n2\n00:01.000 --> 00:02.000\n"), said, F.lit("\n"))
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), vtt.alias("vtt"))
    out = transcripts.caption_lines(rows, "k", "vtt").groupBy("k").agg(F.first("value").alias("value"), F.count("*").alias("lines"))
    return out.select("k.conv_id", "k.turn", "value", "lines")


@query(f"""
    WITH {TASKS_SQL} SELECT id, status IN ('QUEUED', 'DOWNLOADING') AS can_pause, status = 'FAILED' AS can_retry, status = 'QUEUED' AS can_start,
      CASE status WHEN 'QUEUED' THEN 'waiting' WHEN 'DOWNLOADING' THEN 'running' WHEN 'COMPLETED' THEN 'done' ELSE 'failed' END AS label FROM tasks
""")
def task_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-07, PRJ-08, PRJ-09"""
    s = F.col("status")
    label = F.when(s == "QUEUED", "waiting").when(queue.is_active(s), "running").when(s == "COMPLETED", "done").otherwise("failed")
    return tasks(spark, sf_dir).select("id", (queue.is_active(s) | (s == "QUEUED")).alias("can_pause"), (s == "FAILED").alias("can_retry"), (s == "QUEUED").alias("can_start"), label.alias("label"))


@query(f"""
    WITH {TASKS_SQL} SELECT id, row_number() OVER (PARTITION BY queue ORDER BY CASE WHEN status IN ('COMPLETED', 'FAILED') THEN 1 ELSE 0 END, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN -id ELSE position END) AS place FROM tasks
""")
def home_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02"""
    done = queue.is_terminal(F.col("status"))
    place = F.row_number().over(W.partitionBy("queue").orderBy("done", F.when(F.col("done"), -F.col("id")).otherwise(F.col("position"))))
    return tasks(spark, sf_dir).withColumn("done", done).select("id", place.cast("long").alias("place"))


@query(f"WITH {TASKS_SQL} SELECT queue, bool_or(status IN ('QUEUED', 'DOWNLOADING')) AND NOT bool_or(coalesce(pause IN ('STORAGE', 'SYSTEM'), false)) AS recoverable FROM tasks GROUP BY queue")
def recoverable_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-28"""
    open_ = queue.is_active(F.col("status")) | (F.col("status") == "QUEUED")
    held = F.coalesce(F.col("pause").isin("STORAGE", "SYSTEM"), F.lit(False))
    return tasks(spark, sf_dir).groupBy("queue").agg((F.bool_or(open_) & ~F.bool_or(held)).alias("recoverable"))


@query("""
    SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'page' END, 'item') AS title, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 5 END ELSE (c_custkey % 7)::INT END AS episode FROM customer
""")
def metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06: an override that is present replaces everything, its nulls too"""
    k = F.col("c_custkey")
    override = F.when(k % 2 == 0, F.struct(F.when(k % 4 == 0, 5).alias("episode")))
    episode = F.when(override.isNotNull(), override["episode"]).otherwise((k % 7).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.when(k % 3 == 0, "page"), F.lit("item")).alias("title"), episode.alias("episode"))


def merge_headers(base: Column, over: Column) -> Column:
    """PRJ-05: headers by name whatever the case; an override brings its spelling and goes to the end, in order."""
    names = F.transform(F.map_keys(over), lambda k: F.lower(k))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(names, F.lower(k)))
    return F.concat(F.map_entries(kept), F.map_entries(over))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'accept=a;USER-AGENT=x' ELSE 'User-Agent=b;accept=a;referer=' || c_custkey END AS headers FROM customer")
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05"""
    base = F.create_map(F.lit("User-Agent"), F.lit("b"), F.lit("accept"), F.lit("a"))
    over = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("USER-AGENT"), F.lit("x"))).otherwise(F.create_map(F.lit("referer"), F.col("c_custkey").cast("string")))
    merged = F.array_join(F.transform(merge_headers(base, over), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf_dir, "customer").select("c_custkey", merged.alias("headers"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'drama/' || 'a_b' || CASE WHEN p_size % 3 > 0 THEN '/Season 0' || p_size % 3 ELSE '' END || '/' || CASE WHEN p_partkey % 50 > 0 THEN 'E' || lpad((p_partkey % 50)::VARCHAR, 4, '0') || ' ' ELSE '' END || 'T' || p_partkey || '.mp4'
      ELSE 'T' || p_partkey || '.bin' END AS path FROM part
""")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-16, STR-07"""
    k, season = F.col("p_partkey"), F.col("p_size") % 3
    special = k % 2 == 0
    folders = F.array_compact(F.array(F.when(special, F.lit("drama")), F.when(special, T.sanitize(F.lit("a/b"))), F.when(special & (season > 0), F.concat(F.lit("Season "), F.lpad(season.cast("string"), 2, "0")))))
    prefix = F.when(special & (k % 50 > 0), F.concat(F.lit("E"), F.lpad((k % 50).cast("string"), 4, "0"), F.lit(" "))).otherwise("")
    ext = F.when(special, "MP4").otherwise("m p")
    good = F.when(F.rlike(F.lower(ext), F.lit("^[a-z0-9]{1,12}$")), F.lower(ext)).otherwise("bin")
    name = F.concat(T.sanitize(F.concat(prefix, F.lit("T"), k.cast("string"))), F.lit("."), good)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.concat(folders, F.array(name)), "/").alias("path"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'OFF' WHEN p_size % 4 = 1 THEN 'CONFIRMED' ELSE 'WEIGHTED' END AS policy, list_filter([360, 480, 720, 1080], lambda h: h <= p_size * 30) AS caps FROM part")
def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-17, AUX-31"""
    mode = F.col("p_size") % 4
    policy = F.when(mode == 0, "OFF").when(mode == 1, "CONFIRMED").otherwise("WEIGHTED")
    return table(spark, sf_dir, "part").select("p_partkey", policy.alias("policy"), F.filter(cases(360, 480, 720, 1080), lambda h: h <= F.col("p_size") * 30).alias("caps"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 3 END AS episode, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh-TW' END AS language FROM part")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-13, AUX-19"""
    label = pick(cases("第12集", "第 3 集", "預告", "第99999999999集"), F.col("p_partkey") % 4)
    episode = F.regexp_extract(label, r"^第\s*(\d+)\s*[集話话回]$", 1).try_cast("int")
    file = pick(cases("a.b.en.vtt", "a.zh-TW.srt", "plain"), F.col("p_partkey") % 3)
    language = F.nullif(F.regexp_extract(file, r"\.([A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*)\.[a-z]{3,4}$", 1), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", episode.alias("episode"), language.alias("language"))


def hash_code(text: Column) -> Column:
    """AUX-20: the signed 32-bit hash h = 31 * h + c over UTF-16 units, for text within the basic plane."""
    step = lambda h, c: F.pmod(h * 31 + F.ascii(c).cast("long"), F.lit(1 << 32))
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


@query("""
    WITH RECURSIVE h AS (SELECT c_custkey, c_name AS s, 0 AS i, 0::BIGINT AS v FROM customer UNION ALL SELECT c_custkey, s, i + 1, (v * 31 + ascii(s[i + 1])) % 4294967296 FROM h WHERE i < length(s))
    SELECT c_custkey, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS id FROM h WHERE i = length(s)
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUX-20"""
    return table(spark, sf_dir, "customer").select("c_custkey", hash_code(F.col("c_name")).alias("id"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x = 0)::INT)) = len(embedding) AS silent, round(greatest(0.0, least(1.0, embedding[1]::DOUBLE)), 6) AS clamped FROM embeddings")
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-01, NUM-05"""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", features.digital_silence(e).alias("silent"), r6(features.clamp(e[0].cast("double"))).alias("clamped"))


#: Authored cases of the composite score: name, seams, gain in dB, text, box, valid, expected score (fixed values).
BIG, EDGE = (0.2, 0.3, 0.6, 0.2), (0.1, 0.85, 0.8, 0.1)
SAME, CUT, ABA = (0.0, 0.0, 0.0), (0.2, 0.2, 0.2), (0.0, 0.2, 0.2)
VECTORS = [
    ("intro", SAME, 0, "第一集", BIG, True, 50.0),
    ("outro", SAME, 0, "全劇終", BIG, True, 50.0),
    ("credits", SAME, 0, "演員 字幕製作", BIG, True, 10.0),
    ("station-logo", SAME, 0, "TV", (0.9, 0.02, 0.05, 0.05), True, 0.0),
    ("promo-overlay", SAME, 0, "example.com register", EDGE, True, 5.0),
    ("volume-only", SAME, 12, "", BIG, True, 25.0),
    ("hardcut", CUT, 0, "", BIG, True, 7.5),
    ("aba", ABA, 0, "", BIG, True, 40.0),
    ("aba-loud-overlay", ABA, 12, "example.com register", EDGE, True, 70.0),
    ("title-card-hardcut", CUT, 0, "第一集", BIG, True, 57.5),
    ("full-ad", ABA, 12, "example.com register", BIG, True, 100.0),
    ("unverified-full-ad", ABA, 12, "example.com register", BIG, False, 100.0),
]


@query("SELECT id, score, decision, pruned FROM (VALUES " + ", ".join(f"('{v[0]}', {v[6]}::DOUBLE, '{'candidate' if v[5] and v[6] >= 55 else 'unknown'}', {v[1] == SAME and v[2] == 0})" for v in VECTORS) + ") t(id, score, decision, pruned)")
def ad_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-01 to SC-07, AGG-08, AGG-11, NUM-02, NUM-03, STR-17, STR-19"""
    rows = [(v[0], *map(float, v[1]), 100 * 10 ** (v[2] / 20), v[5]) for v in VECTORS]
    side = (F.lit(100.0), F.lit(200.0))
    s = scoring.scene_points(F.col("joined"), F.col("start"), F.col("stop"), [F.lit(0.01), F.lit(0.005)], F.lit(True))
    a = scoring.audio_points(F.col("rms"), F.lit(1000.0), [side, side])
    judged = spark.createDataFrame(rows, "id string, joined double, start double, stop double, rms double, valid boolean").withColumns({"s": s, "a": a})
    seen = spark.createDataFrame([(v[0], t, v[3], 1.0, *v[4]) for v in VECTORS if v[3] for t in (1.0, 5.0, 9.0)], "id string, time double, text string, confidence double, x double, y double, width double, height double")
    outside = spark.createDataFrame([], "id string, domain string, quality double")
    scored = scoring.score(judged, scoring.text_frames(seen, outside))
    return scored.select("id", r6("score").alias("score"), "decision", scoring.cannot_pass(F.col("s"), F.col("a"), 2).alias("pruned"))


#: A dictionary as a table, phrases within phrases among it; longest first for the SQL.
PHRASES = (("the of", "[of the]"), ("ation", "ación"), ("tion", "ción"), ("thre", "3"), ("the", "THE"), ("an", "um"), ("th", "þ"), ("é", "e"), ("o", ""))


@query(f"""
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '(?s){"|".join(p[0] for p in PHRASES)}|.'), lambda x: CASE x {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PHRASES)} ELSE x END), '') AS text,
      CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), 'e', 'E') ELSE coalesce(text, '') END AS chinese FROM documents
""")
def converted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-23, STR-22"""
    known = convert.dictionary(spark.createDataFrame(list(PHRASES), "source string, target string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    language = F.when(F.col("doc_id") % 6 == 0, "zh-Hans").when(F.col("doc_id") % 6 == 3, "YUE").otherwise("en")
    return docs.select("doc_id", convert.converted(F.col("text"), known).alias("text"), convert.normalized(F.col("text"), language, {"e": "E"}).alias("chinese"))


#: Documents as cases: seams and loudness from their numbers, frames from their texts, some with words that speak for either side.
def _best(terms: str) -> str:
    words = ", ".join(f"'{t}'" for t in scoring.LEXICON[terms])
    return f"greatest(0, least(1, (coalesce(list_max(list_transform(w, lambda x: list_max(list_transform([{words}], lambda t: CASE WHEN x = t THEN 1.0 ELSE 1 - levenshtein(x, t)::DOUBLE / greatest(length(x), length(t)) END)))), 0.0) - 0.5) / 0.5))"


SCORES = f"""
    observed AS (SELECT doc_id AS id, 1 + 4 * j AS time, i, regexp_replace(substr(coalesce(text, ''), (1 + 40 * (2 * j + i))::INT, 40), '[^ -~]|[.]', ' ', 'g') || CASE (doc_id + 3 * j + i) % 7 WHEN 0 THEN ' shop' || (doc_id % 50) || '.example.com' WHEN 1 THEN ' Register bonus' WHEN 2 THEN ' elenco' WHEN 3 THEN ' kasino' ELSE '' END AS t,
        (doc_id + 3 * j + i) % 7 = 0 AS named, CASE (doc_id + j + i) % 9 WHEN 8 THEN 1.5 WHEN 7 THEN 0.25 WHEN 6 THEN 0.64 ELSE 1.0 END::DOUBLE AS confidence, i * 0.5::DOUBLE AS x0, CASE (doc_id + j) % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.0 ELSE 0.35 END::DOUBLE AS y0, CASE WHEN (doc_id + i) % 11 = 5 THEN -1.0 ELSE 0.5 END::DOUBLE AS width, 0.1 + 0.05 * (doc_id % 3)::DOUBLE AS height
      FROM documents, (SELECT unnest(range(3)) AS j), (SELECT unnest(range(2)) AS i)),
    read AS (SELECT *, sqrt(confidence) AS q, regexp_extract_all(lower(t), '[a-z]+') AS w, least(x0 + width, 1.0) AS x1, least(y0 + height, 1.0) AS y1, width > 0 AS fits FROM observed WHERE confidence BETWEEN 0 AND 1 AND trim(t) <> ''),
    judged AS (SELECT *, {_best("promotion")} AS promo, {_best("programme")} AS own FROM read),
    weighed AS (SELECT *, q * greatest(named::INT, promo * promo) AS weight, q * least(1, (y1 - y0) / 0.12) * greatest(0, least(x1, 0.8) - greatest(x0, 0.2)) * greatest(0, least(y1, 0.75) - greatest(y0, 0.25)) / ((x1 - x0) * (y1 - y0)) AS big FROM judged),
    frames AS (SELECT id, time, max(CASE WHEN named THEN q * (1 - CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0 END) ELSE 0 END) AS domain, max(q * promo) AS semantic, max(q * own) AS programme, coalesce(max(CASE WHEN fits THEN big END), 0) AS large, count(*) FILTER (NOT fits) AS invalid,
        coalesce(sum(CASE WHEN fits THEN weight * (x1 - x0) * (greatest(0, least(y1, 0.2) - y0) + greatest(0, y1 - greatest(y0, 0.8))) END) / nullif(sum(CASE WHEN fits THEN weight * (x1 - x0) * (y1 - y0) END), 0), 0) AS edge FROM weighed GROUP BY id, time),
    texts AS (SELECT id, sum(domain) / 3 AS domain, sum(semantic) / 3 AS semantic, sum(programme) / 3 AS programme, sum(large) / 3 AS large, sum(20 * (0.65 * domain + 0.35 * semantic) * least(1, edge) * (1 - large)) / 3 AS o, sum(invalid) AS invalid FROM frames GROUP BY id),
    seams AS (SELECT doc_id AS id, (doc_id % 11) / 50.0::DOUBLE AS joined, least((doc_id % 7) / 25.0::DOUBLE, (doc_id % 5) / 20.0::DOUBLE) AS seam, greatest((doc_id % 3) / 100.0::DOUBLE, (doc_id % 2) / 50.0::DOUBLE) AS base, doc_id % 13 <> 4 AS contexts, greatest(0, least(1, 20 * log10(1 + doc_id % 6) / 12)) AS gain, doc_id % 8 <> 3 AS valid FROM documents),
    parts AS (SELECT *, greatest(0, least(1, 1 - joined / greatest(seam, 1 / 255))) AS strength, least(1, seam / (4 / 255)) AS contrast, least(1, base / (1 / 255)) / (1 + joined / greatest(4 * base, 2 / 255)) AS temporal FROM seams),
    cases AS (SELECT id, CASE WHEN contexts THEN 20 * strength * contrast + 5 * contrast + 15 * temporal * contrast ELSE 0 END AS s, 25 * gain AS a, valid FROM parts),
    summed AS (SELECT c.*, coalesce(o, 0) AS o, coalesce(invalid, 0)::BIGINT AS invalid, 25 * (0.65 * least(1, coalesce(domain, 0)) + 0.35 * least(1, coalesce(semantic, 0))) AS p, 40 * least(1, coalesce(programme, 0)) AS m, coalesce(large, 0) AS large FROM cases c LEFT JOIN texts USING (id)),
    total AS (SELECT *, greatest(0, least(100, s + a + least(60, p + 50 * large) - o - m)) AS score FROM summed)
"""


@query(f"WITH {SCORES} SELECT id AS doc_id, round(s, 6) AS s, round(a, 6) AS a, round(p, 6) AS p, round(o, 6) AS o, round(m, 6) AS programme, round(score, 6) AS score, CASE WHEN valid AND score >= 55 THEN 'candidate' ELSE 'unknown' END AS decision, s + a + 50 + 2 < 55 AS pruned, invalid FROM total")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-01 to SC-07, AGG-08, AGG-11, AUX-06, STR-16, STR-17, STR-19, NUM-02, NUM-03"""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    d, j, i = F.col("id"), F.col("j"), F.col("i")
    grid = docs.withColumn("j", F.explode(F.array(*map(F.lit, range(3))))).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    shop = F.concat(F.lit("shop"), (d % 50).cast("string"), F.lit(".example.com"))
    kind = (d + 3 * j + i) % 7
    word = F.when(kind == 0, F.concat(F.lit(" "), shop)).when(kind == 1, " Register bonus").when(kind == 2, " elenco").when(kind == 3, " kasino").otherwise("")
    said = F.regexp_replace(F.substr("text", (1 + 40 * (2 * j + i)).cast("int"), F.lit(40)), "[^ -~]|[.]", " ")
    sure = (d + j + i) % 9
    seen = grid.select(
        "id",
        (1.0 + 4 * j).alias("time"),
        i.alias("nth"),
        F.concat(said, word).alias("text"),
        F.when(sure == 8, 1.5).when(sure == 7, 0.25).when(sure == 6, 0.64).otherwise(1.0).alias("confidence"),
        (i * 0.5).alias("x"),
        F.when((d + j) % 4 == 0, 0.85).when((d + j) % 4 == 1, 0.0).otherwise(0.35).alias("y"),
        F.when((d + i) % 11 == 5, -1.0).otherwise(0.5).alias("width"),
        (0.1 + 0.05 * (d % 3)).alias("height"),
    )
    outside = docs.where("id % 3 = 0").select("id", shop.alias("domain"), F.lit(0.5).alias("quality"))
    side = (F.lit(100.0), F.lit(200.0))
    silent = (F.when(d % 4 == 1, 0.0).otherwise(100.0), F.lit(200.0))
    s = scoring.scene_points((d % 11) / 50, (d % 7) / 25, (d % 5) / 20, [(d % 3) / 100, (d % 2) / 50], d % 13 != 4)
    a = scoring.audio_points(100.0 * (1 + d % 6), F.lit(1000.0), [side, silent])
    cases = docs.select("id", s.alias("s"), a.alias("a"), (d % 8 != 3).alias("valid"))
    scored = scoring.score(cases, scoring.text_frames(seen, outside))
    rounded = [r6(c).alias(c) for c in ("s", "a", "p", "o", "programme", "score")]
    return scored.select(F.col("id").alias("doc_id"), *rounded, "decision", scoring.cannot_pass(F.col("s"), F.col("a"), 3, -8.0).alias("pruned"), "invalid")


#: Events as news of a queue of five jobs: the attempt that a report names is right in two of three cases.
_JOBS = """
    e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_ms(ts) AS t, event_id % 5 + 1 AS task, event_id % 3 AS off, event_id % 4 > 0 AS text,
      CASE event_id % 9 WHEN 0 THEN 'enqueue' WHEN 1 THEN 'enqueue' WHEN 2 THEN 'claim' WHEN 3 THEN 'claim' WHEN 4 THEN 'beat' WHEN 5 THEN 'beat' WHEN 6 THEN 'finish' WHEN 7 THEN 'fail' ELSE 'cancel' END AS kind FROM events),
    f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::BIGINT AS task, NULL::BIGINT AS attempt, NULL::BIGINT AS parts, false AS lost, NULL::BIGINT AS lost_task,
        ['none', 'none', 'none', 'none', 'none'] AS st, [0, 0, 0, 0, 0]::BIGINT[] AS att, [0, 0, 0, 0, 0]::BIGINT[] AS pl, [0, 0, 0, 0, 0]::BIGINT[] AS pa, [false, false, false, false, false] AS tx, 0::BIGINT AS nxt, 0::BIGINT AS run, 0::BIGINT AS heard FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT user_id, k, event_id, action, CASE WHEN action IS NOT NULL THEN job END,
        CASE WHEN action = 'claimed' THEN att[job] + 1 ELSE att[job] END, CASE action WHEN 'heard' THEN pa[job] + 1 WHEN 'queued' THEN CASE WHEN st[job] = 'failed' THEN pa[job] ELSE 0 END ELSE pa[job] END, lost, lost_task,
        CASE WHEN action IS NULL OR action = 'heard' THEN st ELSE list_transform(st, lambda x, i: CASE WHEN i = job THEN CASE action WHEN 'claimed' THEN 'running' ELSE action END ELSE x END) END,
        CASE WHEN action = 'claimed' THEN list_transform(att, lambda x, i: x + (i = job)::BIGINT) ELSE att END,
        CASE WHEN action = 'queued' THEN list_transform(pl, lambda x, i: CASE WHEN i = job THEN nxt ELSE x END) ELSE pl END,
        CASE WHEN action = 'heard' THEN list_transform(pa, lambda x, i: x + (i = job)::BIGINT) WHEN action = 'queued' AND st[job] <> 'failed' THEN list_transform(pa, lambda x, i: CASE WHEN i = job THEN 0 ELSE x END) ELSE pa END,
        CASE WHEN action IN ('completed', 'failed') THEN list_transform(tx, lambda x, i: CASE WHEN i = job THEN text ELSE x END) WHEN action = 'queued' THEN list_transform(tx, lambda x, i: i <> job AND x) ELSE tx END,
        nxt + (action IS NOT DISTINCT FROM 'queued')::BIGINT, CASE WHEN action = 'claimed' THEN job WHEN action IN ('completed', 'failed') OR (action = 'cancelled' AND run = job) THEN 0 ELSE run END,
        CASE WHEN action IN ('claimed', 'heard') THEN t ELSE heard END
      FROM (SELECT *, CASE kind WHEN 'enqueue' THEN CASE WHEN st[task] IN ('queued', 'running') OR (st[task] = 'completed' AND tx[task]) THEN NULL ELSE 'queued' END
            WHEN 'claim' THEN CASE WHEN run = 0 AND first > 0 THEN 'claimed' END
            WHEN 'cancel' THEN CASE WHEN st[task] IN ('queued', 'running') THEN 'cancelled' END
            ELSE CASE WHEN st[task] = 'running' AND (off <> 2) THEN CASE kind WHEN 'beat' THEN 'heard' WHEN 'finish' THEN 'completed' ELSE 'failed' END END END AS action,
            CASE WHEN kind = 'claim' THEN first ELSE task END AS job
          FROM (SELECT *, coalesce(list_sort(list_filter(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN st[i] = 'queued' THEN {'p': pl[i], 'i': i} END), lambda x: x IS NOT NULL))[1].i, 0) AS first
            FROM (SELECT e.user_id, e.k, e.event_id, e.t, e.task, e.off, e.text, e.kind, f.att, f.pl, f.pa, f.tx, f.nxt, f.heard, f.run > 0 AND f.heard + 86400000 <= e.t AS lost, f.run AS lost_task,
              CASE WHEN f.run > 0 AND f.heard + 86400000 <= e.t THEN 0 ELSE f.run END AS run,
              CASE WHEN f.run > 0 AND f.heard + 86400000 <= e.t THEN list_transform(f.st, lambda x, i: CASE WHEN i = f.run THEN 'queued' ELSE x END) ELSE f.st END AS st
              FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))))
"""


@query(f"""
    WITH RECURSIVE {_JOBS}
    SELECT user_id, event_id, action, task, attempt, parts FROM f WHERE action IS NOT NULL
    UNION ALL SELECT a.user_id, NULL, 'expired', a.lost_task, b.att[a.lost_task], b.pa[a.lost_task] FROM f a JOIN f b ON b.user_id = a.user_id AND b.k = a.k - 1 WHERE a.lost
""")
def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-09, STM-13, STM-15"""
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, ("enqueue", "enqueue", "claim", "claim", "beat", "beat", "finish", "fail", "cancel")))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.get(kinds, (e % 9).cast("int")).alias("kind"), (e % 5 + 1).alias("task"), (e % 3 != 2).alias("right"), (e % 4 > 0).alias("text"))

    class Reports(stateful.Jobs):
        """News names its attempt as right or wrong, as the table has no attempts."""

        def step(self, state: dict, row: dict) -> list[dict]:
            job = state["jobs"].get(str(row["task"]))
            return super().step(state, row | {"attempt": job["attempt"] - (not row["right"]) if job else 0})

    return stateful.over_table(rows, "user_id", "ts", ["event_id"], Reports(86400000))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 6 = 0 AS restart, CASE WHEN event_id % 24 = 6 THEN NULL ELSE event_id % 5000 END AS seen, event_id % 97 AS size,
      CASE WHEN event_id % 60 = 12 THEN 'other' ELSE 'own' END AS identity, CASE event_id % 10 WHEN 3 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS off FROM events),
    f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS result, NULL::VARCHAR AS s_id, 0::BIGINT AS s_n, 0::BIGINT AS s_a, 0::BIGINT AS s_z, NULL::BIGINT AS n, 0::BIGINT AS z, NULL::BIGINT AS o_n, NULL::BIGINT AS o_a, NULL::BIGINT AS o_z FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, k, event_id, result, CASE WHEN result = 'prepared' AND s_id IS NULL THEN identity ELSE s_id END, CASE WHEN result = 'appended' THEN n + 1 ELSE s_n END, CASE WHEN result = 'appended' THEN z ELSE s_a END, CASE WHEN result = 'appended' THEN z + size ELSE s_z END,
        CASE result WHEN 'prepared' THEN greatest(0, s_n - 1) WHEN 'appended' THEN n + 1 ELSE n END, CASE result WHEN 'prepared' THEN s_a WHEN 'appended' THEN z + size ELSE z END,
        CASE result WHEN 'prepared' THEN greatest(0, s_n - 1) WHEN 'appended' THEN n + 1 END, CASE result WHEN 'prepared' THEN s_a WHEN 'appended' THEN z END, CASE result WHEN 'prepared' THEN s_a WHEN 'appended' THEN z + size END
      FROM (SELECT e.*, f.s_id, f.s_n, f.s_a, f.s_z, f.n, f.z, CASE WHEN restart THEN CASE WHEN f.s_id IS NULL THEN CASE WHEN coalesce(seen, 0) > 0 THEN 'no_checkpoint' ELSE 'prepared' END WHEN f.s_id <> identity THEN 'other_session'
          WHEN coalesce(seen, 0) < f.s_a OR (f.s_n > 0 AND seen IS NULL) THEN 'shorter' ELSE 'prepared' END
        WHEN f.n IS NULL OR e.off <> 0 OR size = 0 OR f.n >= 40 THEN 'refused' ELSE 'appended' END AS result FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
    SELECT user_id, event_id, result, o_n AS fragment, o_a AS start, o_z AS stop FROM f WHERE result IS NOT NULL
""")
def append_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06"""
    e = F.col("event_id")
    restart = e % 6 == 0
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "ts",
        F.when(restart, "restart").otherwise("append").alias("kind"),
        F.when(restart, F.when(e % 24 != 6, e % 5000)).otherwise(e % 97).alias("size"),
        F.when(e % 60 == 12, "other").otherwise("own").alias("identity"),
        F.when(e % 10 == 3, -1).when(e % 10 == 4, 1).otherwise(0).alias("off"),
    )

    class Offsets(stateful.Appends):
        """Fragments are told as the next one plus an offset, as the table has no numbers."""

        def step(self, state: dict, row: dict) -> list[dict]:
            return super().step(state, row | {"fragment": (state["fragment"] or 0) + 1 + row["off"]})

    return stateful.over_table(rows, "user_id", "ts", ["event_id"], Offsets(40))
