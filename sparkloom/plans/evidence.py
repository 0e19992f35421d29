"""Registered queries over evidence: byte payloads, cut borders, journals and receipts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import journal, payloads, retained
from ..registry import query
from .catalogue import table

# Payloads: pages repeated a few or very many times stand for files, and the catalog is cut from the first page


def catalog(html: str) -> list[payloads.Signature]:
    """Three payloads of a page: its opening with what follows, the opening alone, and a passage around its title's end."""
    data = html.encode()
    title = data.find(b"</title>")
    part = lambda name, a, n, offset: payloads.Signature(name, n, hashlib.sha256(data[a : a + n]).hexdigest(), data[a + offset : a + offset + 64], offset)
    return [part("opening", 0, 200, 0), part("head", 0, 64, 0), part("title", title - 20, 150, 20)]


@query("""
    WITH RECURSIVE first AS (SELECT hex(encode(html)) AS h FROM pages ORDER BY page_id LIMIT 1),
    known(s, n, o, anchor, digest) AS (
      SELECT 0, 200, 0, h[1:128], sha256(unhex(h[1:400])) FROM first
      UNION ALL SELECT 1, 64, 0, h[1:128], sha256(unhex(h[1:128])) FROM first
      UNION ALL SELECT 2, 150, 20, h[t:t + 127], sha256(unhex(h[t - 40:t + 259])) FROM (SELECT h, strpos(h, hex(encode('</title>'))) AS t FROM first)),
    files AS (SELECT page_id, repeat(hex(encode(coalesce(html, ''))), CASE WHEN page_id % 40 = 5 THEN 20 WHEN page_id % 40 = 11 THEN 150 ELSE 1 + page_id % 4 END::INT) AS h FROM pages),
    seek AS (SELECT page_id, s, 0::BIGINT AS p, 0::BIGINT AS nth FROM files, known
      UNION ALL SELECT page_id, s, q, nth + ((q % 2) = 1)::BIGINT FROM (SELECT k.page_id, k.s, k.nth, CASE WHEN x > 0 THEN k.p + x ELSE 0 END AS q FROM (SELECT seek.*, strpos(files.h[seek.p + 1:], known.anchor) AS x FROM seek JOIN files USING (page_id) JOIN known USING (s) WHERE nth < 130) k) WHERE q > 0),
    hits AS (SELECT page_id, s, (p - 1) // 2 - o AS a, (p - 1) // 2 - o + n AS z, n, digest, row_number() OVER (PARTITION BY page_id ORDER BY s, p) AS i FROM seek JOIN known USING (s) WHERE p % 2 = 1),
    proof AS (SELECT hits.*, a >= 0 AND 2 * z <= length(h) AND sha256(unhex(CASE WHEN a >= 0 AND 2 * z <= length(h) THEN h[2 * a + 1:2 * z] ELSE '' END)) = digest AS ok FROM hits JOIN files USING (page_id) WHERE i <= 129),
    run AS (SELECT *, sum(ok::INT) OVER (PARTITION BY page_id ORDER BY i) AS m, lag(z) OVER (PARTITION BY page_id, ok ORDER BY a, z) > a AND ok AS over FROM proof),
    per AS (SELECT page_id, max(i) AS n, min(i) FILTER (m > 16) AS many, bool_or(over) AS over, string_agg(a || '-' || z, ',' ORDER BY a, z) FILTER (ok) AS spans FROM run GROUP BY page_id)
    SELECT page_id, CASE WHEN many <= 128 THEN many ELSE coalesce(n, 0) END AS candidates,
      CASE WHEN many <= 128 THEN 'matches' WHEN n > 128 THEN 'candidates' WHEN over THEN 'overlap' END AS error,
      CASE WHEN coalesce(many, 999) > 128 AND coalesce(n, 0) <= 128 AND NOT coalesce(over, false) THEN coalesce(spans, '') END AS spans
    FROM files LEFT JOIN per USING (page_id)
""")
def payload_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-14, AUX-03"""
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    first = pages.orderBy("page_id").first()
    times = F.when(F.col("page_id") % 40 == 5, 20).when(F.col("page_id") % 40 == 11, 150).otherwise(1 + F.col("page_id") % 4)
    files = pages.select(F.col("page_id").alias("key"), F.repeat("html", times.cast("int")).cast("binary").alias("content"))
    if first is None:
        return files.select(F.col("key").alias("page_id"), F.lit(0).cast("long").alias("candidates"), F.lit(None).cast("string").alias("error"), F.lit("").alias("spans"))
    size = 1 << 16
    found = payloads.find_payloads(files.select("key", F.octet_length("content").alias("size")), payloads.cut(files, "key", "content", size), catalog(first.html), size)
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws("-", m["start"], m["stop"])), ",")
    return found.select(F.col("key").alias("page_id"), "candidates", "error", spans.alias("spans"))


#: Orders as files, lineitems as packets: sizes by quantity, some of no width, some longer than the way to the next one.
PACKETS = """
    numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
    raw AS (SELECT l_orderkey AS key, i, CASE WHEN l_quantity % 10 = 0 THEN 0 ELSE l_quantity * 9 END::BIGINT AS step, l_returnflag <> 'N' OR l_orderkey % 3 = 0 AS keyframe, i % 5 <> 3 AS video,
      CASE WHEN l_orderkey % 11 = 4 AND i = 2 THEN 1 ELSE i * 3 END::BIGINT AS dts, CASE WHEN l_orderkey % 13 = 5 AND i = 2 THEN 0 ELSE 2 END::BIGINT AS duration FROM numbered),
    packets AS (SELECT key, i, coalesce(sum(step) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, greatest(step, 1) + CASE WHEN key % 5 = 1 THEN 3 ELSE 0 END AS size, video, keyframe, dts, dts + CASE WHEN key % 17 = 6 THEN 40 - 9 * i ELSE i % 2 END AS pts, duration FROM raw)
"""


@query(f"""
    WITH {PACKETS},
    sizes AS (SELECT key, max(pos + size) - CASE WHEN key % 19 = 7 THEN 1 ELSE 0 END AS bytes FROM packets GROUP BY key),
    spans AS (SELECT key, min(pos) FILTER (i = 1) AS start, min(pos) FILTER (i = 4) + (key % 4 = 3)::BIGINT AS stop FROM packets GROUP BY key
      UNION ALL SELECT key, min(pos) FILTER (i = 5), min(pos) FILTER (i = 6) FROM packets GROUP BY key),
    good AS (SELECT * FROM spans WHERE start < stop),
    health AS (SELECT key, bool_or(pos < 0 OR pos >= bytes OR size <= 0 OR pos + size > bytes OR duration <= 0) AS bad, bool_or(coalesce(back, false)) AS back
      FROM (SELECT *, dts <= max(dts) OVER (PARTITION BY key, video ORDER BY pos, dts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM packets JOIN sizes USING (key)) GROUP BY key),
    marks AS (SELECT DISTINCT key, spot FROM (SELECT key, start AS spot FROM good UNION ALL SELECT key, stop FROM good)),
    seen AS (SELECT m.key, m.spot, bool_or(pos < spot AND spot < pos + size) AS cut, count(*) FILTER (pos = spot AND video) AS n, bool_and(keyframe) FILTER (pos = spot AND video) AS k, max(pts) FILTER (pos = spot AND video) AS pts, max(dts) FILTER (pos = spot AND video) AS dts
      FROM marks m JOIN packets p ON p.key = m.key GROUP BY ALL),
    joined AS (SELECT g.*, h.bad, h.back, a.cut OR z.cut AS cut, a.n = 1 AND z.n = 1 AND a.k AND z.k AS keyed, a.pts AS ap, a.dts AS ad, z.pts AS zp, z.dts AS zd, lag(z.pts) OVER w AS lp, lag(z.dts) OVER w AS ld
      FROM good g JOIN health h USING (key) JOIN seen a ON a.key = g.key AND a.spot = g.start JOIN seen z ON z.key = g.key AND z.spot = g.stop WINDOW w AS (PARTITION BY g.key ORDER BY g.start)),
    judged AS (SELECT *, CASE WHEN bad THEN 'packet' WHEN back THEN 'order' WHEN cut THEN 'cut' WHEN NOT coalesce(keyed, false) THEN 'keyframe' WHEN coalesce(ap < lp OR ad < ld, false) OR zp <= ap OR zd <= ad THEN 'time' END AS refused FROM joined)
    SELECT key AS l_orderkey, start, stop, refused, CASE WHEN refused IS NULL THEN zp - ap END AS ticks FROM judged
""")
def cut_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08"""
    i, key = F.col("i"), F.col("l_orderkey")
    step = F.when(F.col("l_quantity") % 10 == 0, 0).otherwise(F.col("l_quantity") * 9).cast("long")
    dts = F.when((key % 11 == 4) & (i == 2), 1).otherwise(i * 3).cast("long")
    before = W.partitionBy("key").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    packets = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(own)).select(
        key.alias("key"),
        "i",
        step.alias("step"),
        (F.greatest(step, F.lit(1)) + F.when(key % 5 == 1, 3).otherwise(0)).alias("size"),
        (i % 5 != 3).alias("video"),
        ((F.col("l_returnflag") != "N") | (key % 3 == 0)).alias("keyframe"),
        dts.alias("dts"),
        (dts + F.when(key % 17 == 6, 40 - 9 * i).otherwise(i % 2)).alias("pts"),
        F.when((key % 13 == 5) & (i == 2), 0).otherwise(2).cast("long").alias("duration"),
    )
    packets = packets.withColumns({"pos": F.coalesce(F.sum("step").over(before), F.lit(0)), "stream": F.col("video")})
    per = packets.groupBy("key").agg(F.max(F.col("pos") + F.col("size")).alias("bytes"), *(F.min(F.when(F.col("i") == n, F.col("pos"))).alias(f"p{n}") for n in (1, 4, 5, 6)))
    spans = per.select("key", F.col("p1").alias("start"), (F.col("p4") + (F.col("key") % 4 == 3).cast("long")).alias("stop")).union(per.select("key", "p5", "p6")).where("start < stop")
    sizes = per.select("key", (F.col("bytes") - F.when(F.col("key") % 19 == 7, 1).otherwise(0)).alias("bytes"))
    return payloads.removals(packets, spans, sizes, 256).withColumnRenamed("key", "l_orderkey")


# Journals: a user's events are the candidates of a job, finished in order. Some records are written with wrong evidence, some
# damaged or lost afterwards, and some jobs come back with another binding.

PAYLOAD = (
    '{"cumulative_elapsed_seconds":%d,"elapsed_seconds":%d,"features":{"candidate_gate":"valid","errors":[],"inputs":{"candidate":{"status":"ok"}},"ocr":{}},'
    '"row":{"decision":"%s","duration_seconds":%d,"errors":[],"expected_absence_count":0,"region_indices":[%d],"score":%d,"segment_indices":[%d,%d],"status":"scored"},'
    '"weighted":{"candidate_source_gate":{"valid":true},"decision":"%s","score":%d}}'
)
CANDIDATE = '{"duration_seconds":%d,"region_indices":[%d],"segment_indices":[%d,%d]}'
BINDING = '{"candidate_count":%d,"candidates_sha256":"%s","manifest_sha256":"%s","request_sha256":"%s","reusable_prefix_count":%d,"reusable_prefix_sha256":"%s","runtime_policy_sha256":"%s","schema":1,"score_threshold":55,"snapshot_identity":"%s"}'
_quote = lambda x: x.replace("'", "''")
JOURNAL = f"""
    events_ AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o, count(*) OVER (PARTITION BY user_id) AS many, event_id % 101 AS score, 1 + event_id % 60 AS d, event_id % 7 AS spent FROM events),
    made AS (SELECT *, sum(spent) OVER (PARTITION BY key ORDER BY o)::BIGINT + (event_id % 211 = 7)::BIGINT AS total, score + (event_id % 223 = 9)::BIGINT AS told, o + (event_id % 227 = 11)::BIGINT AS region, CASE WHEN score >= 55 THEN 'experimental_ad_candidate' ELSE 'unknown' END AS verdict,
      printf('{CANDIDATE}', d, o, 2 * o, 2 * o + 1) AS c FROM events_),
    jobs AS (SELECT key, sha256(printf('{_quote(BINDING)}', many, sha256(key || 'c'), sha256(key || 'm'), sha256(key || 'r'), many, sha256(key || 'c'), sha256('policy'), sha256(key || 's'))) AS identity,
      CASE key % 11 WHEN 3 THEN 'checkpoint_source_changed' WHEN 5 THEN 'checkpoint_runtime_policy_changed' WHEN 7 THEN 'checkpoint_candidates_changed' WHEN 9 THEN 'checkpoint_active_binding_invalid' END AS cause FROM (SELECT DISTINCT key, many FROM events_)),
    rows_ AS (SELECT *, printf('{_quote(PAYLOAD)}', total, spent, verdict, d, region, told, 2 * o, 2 * o + 1, verdict, score) AS payload FROM made),
    chain AS (SELECT key, -1::BIGINT AS o, NULL::BIGINT AS event_id, NULL::VARCHAR AS payload, NULL::VARCHAR AS previous, identity AS record FROM jobs
      UNION ALL SELECT key, o, event_id, payload, record, sha256(printf('{{"candidate_sha256":"%s","ordinal":%d,"payload":%s,"payload_sha256":"%s","previous_sha256":"%s","schema":1}}', sha256(c), o, payload, sha256(payload), record))
      FROM (SELECT r.key, r.o, r.event_id, r.payload, r.c, chain.record FROM chain JOIN rows_ r ON r.key = chain.key AND r.o = chain.o + 1)),
    kept AS (SELECT *, lag(record) OVER (PARTITION BY key ORDER BY o) AS chained, row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS place FROM chain JOIN jobs USING (key) WHERE cause IS NULL AND o >= 0 AND event_id % 89 <> 13),
    judged AS (SELECT kept.*, spent, total, lag(total, 1, 0) OVER (PARTITION BY kept.key ORDER BY kept.o) AS before, CASE WHEN kept.o <> place THEN 'checkpoint_missing_candidate_' || place
      WHEN event_id_ % 97 = 17 OR event_id_ % 193 = 19 OR previous <> coalesce(chained, identity) THEN 'checkpoint_invalid_candidate_' || kept.o || ': checkpoint_record_identity_or_checksum_mismatch'
      WHEN region <> kept.o THEN 'checkpoint_invalid_candidate_' || kept.o || ': checkpoint_candidate_row_mismatch'
      WHEN told <> score THEN 'checkpoint_invalid_candidate_' || kept.o || ': checkpoint_row_score_gate_decision_mismatch'
      WHEN total <> lag(total, 1, 0) OVER (PARTITION BY kept.key ORDER BY kept.o) + spent THEN 'checkpoint_invalid_candidate_' || kept.o || ': checkpoint_elapsed_mismatch' END AS reason
      FROM kept JOIN (SELECT key AS key_, o AS o_, event_id AS event_id_, region, told, score, spent, total FROM made) m ON key_ = kept.key AND o_ = kept.o),
    good AS (SELECT *, bool_and(reason IS NULL) OVER (PARTITION BY key ORDER BY o ROWS UNBOUNDED PRECEDING) AS usable FROM judged)
"""


def journals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, candidates, jobs) of the users' events."""
    own = W.partitionBy("key").orderBy("o")
    e, o = F.col("event_id"), F.col("o")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    rows = rows.withColumns({"o": F.row_number().over(W.partitionBy("key").orderBy("event_id")).cast("long") - 1, "many": F.count("*").over(W.partitionBy("key")), "score": e % 101, "d": 1 + e % 60, "spent": e % 7})
    wrong = lambda n, r: (e % n == r).cast("long")
    verdict = F.when(F.col("score") >= 55, "experimental_ad_candidate").otherwise("unknown")
    rows = rows.withColumns({"total": F.sum("spent").over(own) + wrong(211, 7), "told": F.col("score") + wrong(223, 9), "region": o + wrong(227, 11), "verdict": verdict})
    digest = lambda x: F.sha2(F.concat(F.col("key").cast("string"), F.lit(x)), 256)
    names = {"snapshot_identity": digest("s"), "manifest_sha256": digest("m"), "request_sha256": digest("r"), "runtime_policy_sha256": F.sha2(F.lit("policy"), 256), "score_threshold": F.lit(55), "candidate_count": F.col("many"), "candidates_sha256": digest("c"), "reusable_prefix_count": F.col("many"), "reusable_prefix_sha256": digest("c")}
    changed = {3: "manifest_sha256", 5: "runtime_policy_sha256", 7: "candidates_sha256"}
    saved = {n: F.when(F.col("key") % 11 == {v: k for k, v in changed.items()}[n], F.lit("0" * 64)).otherwise(c) if n in changed.values() else c for n, c in names.items()}
    jobs = rows.select("key", "many").distinct()
    jobs = jobs.select("key", F.struct(*(c.alias(n) for n, c in names.items())).alias("now"), F.struct(*(c.alias(n) for n, c in saved.items())).alias("saved"))
    cause = journal.binding_reason(F.when(F.col("key") % 11 != 1, F.col("saved")), F.col("now"), F.col("key") % 11 != 9)
    jobs = jobs.select("key", F.sha2(journal.binding_text(F.col("now")), 256).alias("identity"), F.lit(55).alias("threshold"), cause.alias("cause")).withColumn("void", F.col("cause").isNotNull())
    described = F.format_string(CANDIDATE, F.col("d"), o, 2 * o, 2 * o + 1)
    candidate = F.struct(F.array(o).alias("region_indices"), F.array(2 * o, 2 * o + 1).alias("segment_indices"), F.col("d").cast("double").alias("duration_seconds"))
    candidates = rows.select("key", o.alias("ordinal"), F.sha2(described, 256).alias("candidate_sha256"), candidate.alias("candidate"), "event_id")
    payload = F.format_string(PAYLOAD, "total", "spent", "verdict", "d", "region", "told", 2 * o, 2 * o + 1, "verdict", "score")
    written = journal.committed(rows.select("key", o.alias("ordinal"), F.sha2(described, 256).alias("candidate_sha256"), payload.alias("payload")).join(jobs.select("key", "identity"), "key"))
    # lost records, payloads changed on disk, links that point elsewhere
    held = written.join(candidates.select("key", "ordinal", "event_id"), ["key", "ordinal"]).where(e % 89 != 13)
    held = held.withColumn("payload", F.when(e % 97 == 17, F.concat(F.col("payload"), F.lit(" "))).otherwise(F.col("payload")))
    held = held.withColumn("previous_sha256", F.when(e % 193 == 19, F.lit("0" * 64)).otherwise(F.col("previous_sha256")))
    return held.drop("event_id"), candidates, jobs


@query(f"WITH RECURSIVE {JOURNAL} SELECT key AS user_id, count(o) FILTER (usable) AS completed, coalesce(max(total) FILTER (usable), 0)::DOUBLE AS saved_seconds, coalesce(any_value(jobs.cause), arg_min(reason, place) FILTER (reason IS NOT NULL)) AS reason FROM jobs LEFT JOIN good USING (key) GROUP BY key")
def journal_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07"""
    return journal.restored(*journals(spark, sf_dir)).withColumnRenamed("key", "user_id")


@query(f"WITH RECURSIVE {JOURNAL} SELECT key AS user_id, event_id FROM good WHERE usable")
def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-17"""
    records, candidates, jobs = journals(spark, sf_dir)
    usable = journal.checked(records, candidates, jobs).where("usable").select("key", "ordinal")
    return usable.join(candidates, ["key", "ordinal"]).select(F.col("key").alias("user_id"), "event_id")


# Kept media: orders as files, their lineitems as packets of two streams, with a receipt that is damaged in one way or another

MEDIA = """
    numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
    packets AS (SELECT l_orderkey AS key, CASE WHEN i % 2 = 1 THEN 'video' ELSE 'audio' END AS kind, i AS position, l_quantity::BIGINT AS size, sha256(l_partkey || ':' || l_suppkey) AS digest, i * 2 AS pts, CASE WHEN l_orderkey % 23 = 5 AND i = 3 THEN 0 ELSE i END AS dts FROM numbered),
    rel AS (SELECT *, pts - min(pts) OVER (PARTITION BY key, kind) AS p, dts - min(dts) OVER (PARTITION BY key, kind) AS d FROM packets),
    prints AS (SELECT key, kind, sum(size)::BIGINT AS amount, sha256(string_agg(digest, chr(10) ORDER BY position) || chr(10)) AS sha FROM packets GROUP BY ALL
      UNION ALL SELECT key, 'video_timing', count(*), sha256(string_agg(p || ',' || d, chr(10) ORDER BY position) || chr(10)) FROM rel WHERE kind = 'video' GROUP BY key),
    health AS (SELECT key, bool_or(coalesce(back, false)) AS back, count(DISTINCT kind) AS streams FROM (SELECT *, dts <= max(dts) OVER (PARTITION BY key, kind ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM packets) GROUP BY key),
    files AS (SELECT key, back, streams, (SELECT count(*) FROM prints p WHERE p.key = h.key) = 3 AS whole FROM health h),
    told AS (SELECT *, CASE WHEN key % 10 = 1 THEN 'not_enabled' WHEN key % 10 = 2 THEN 'receipt_unavailable' WHEN key % 11 IN (1, 2, 3, 4, 5) THEN 'incomplete_or_stale_receipt' WHEN key % 13 IN (1, 2) THEN 'unsupported_audio_configuration' WHEN key % 13 = 3 THEN 'validator_or_engine_changed'
        WHEN key % 17 = 1 OR NOT whole THEN 'invalid_fingerprints' WHEN key % 17 IN (2, 3) THEN 'encoded_content_mismatch_or_unavailable' ELSE 'complete_decode_and_encoded_content_match' END AS why FROM files),
    judged AS (SELECT *, CASE WHEN key % 7 = 3 THEN 'requires_requested_streams:aac,h264' WHEN key % 7 = 4 THEN 'retained_duration_mismatch' WHEN back THEN 'non_monotonic_retained_packet_dts' WHEN streams <> 2 THEN 'retained_packet_probe_failed' END AS early,
        why = 'complete_decode_and_encoded_content_match' AS reused FROM told)
"""


@query(f"""
    WITH {MEDIA}, ended AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN NOT reused AND key % 3 = 1 THEN 'retained_full_av_decode_failed' WHEN key % 29 = 7 THEN 'retained_media_changed_during_validation' END AS reason FROM judged)
    SELECT key AS l_orderkey, CASE WHEN reason IS NULL THEN 'valid' ELSE 'unknown' END AS status, reason, CASE WHEN early IS NULL THEN CASE WHEN reused THEN 'during_download' ELSE 'after_download' END END AS method, CASE WHEN early IS NULL THEN why END AS receipt FROM ended
""")
def kept_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-16, AGG-09, AGG-20, SC-15"""
    i, key = F.col("i"), F.col("key")
    own = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    packets = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(own)).select(
        F.col("l_orderkey").alias("key"),
        F.when(i % 2 == 1, "video").otherwise("audio").alias("kind"),
        i.alias("position"),
        F.col("l_quantity").cast("long").alias("size"),
        F.sha2(F.concat_ws(":", "l_partkey", "l_suppkey"), 256).alias("digest"),
        (i * 2).alias("pts"),
        F.when((F.col("l_orderkey") % 23 == 5) & (i == 3), 0).otherwise(i).alias("dts"),
    )
    # a receipt has the fingerprints of what was downloaded, which is the file unless it was changed
    prints = retained.fingerprints(packets)
    changed = F.transform_values("prints", lambda k, v: F.when((k == "audio") & (F.col("key") % 17 == 2) | (k == "video_timing") & (F.col("key") % 17 == 3), v.withField("sha256", F.lit("0" * 64))).otherwise(v))
    said = F.when(key % 17 == 1, F.map_filter("prints", lambda k, v: k != "audio")).otherwise(changed)
    odd = lambda r, a, b: F.when(key % 11 == r, a).otherwise(b)
    session = F.struct(F.lit(1).alias("schema"), F.lit("video").alias("mode"), F.lit("t").alias("token"), F.lit("s").alias("identity"), F.array(F.lit(4.5), F.lit(5.5)).alias("durations"))
    receipt = F.struct(
        F.lit(1).alias("schema"), odd(1, "open", "valid").alias("status"), odd(2, "other", "s").alias("identity"), F.lit("t").alias("token"), F.lit("video").alias("mode"), F.lit(True).alias("eof"), odd(3, F.lit(None).cast("boolean"), F.lit(True)).alias("full_decode"),
        odd(4, 3, 2).alias("segments"), F.lit(9).alias("source_bytes"), odd(5, "x", "a" * 64).alias("source_sha256"), F.when(key % 13 == 3, "old").otherwise("tool").alias("tool"), said.alias("prints"),
    )
    files = prints.select(
        "key",
        F.lit(10.0).alias("expected"),
        F.when(key % 7 == 4, 11.5).otherwise(10.5).alias("actual"),
        F.when(key % 7 == 3, F.array(F.lit("aac"), F.lit("hevc"))).otherwise(F.array(F.lit("h264"), F.lit("aac"))).alias("codecs"),
        F.when(key % 10 != 1, session).alias("session"),
        F.when(key % 10 != 2, receipt).alias("receipt"),
        F.struct(F.when(key % 13 == 1, "HE-AAC").otherwise("LC").alias("profile"), F.when(key % 13 == 2, 6).otherwise(2).alias("channels")).alias("audio"),
        F.lit("tool").alias("tool"),
        (key % 3 != 1).alias("decodes"),
        (key % 29 == 7).alias("changed"),
        "prints",
    )
    return retained.validated(files, packets).withColumnRenamed("key", "l_orderkey")
