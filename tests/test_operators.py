"""Operators on literal inputs with known results."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import features, matching, playlist, queue, transcripts, windows
from sparkloom.plans import scoring
from sparkloom.session import tuned
from sparkloom.sources import manifests
from sparkloom.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "url"),
    [("see https://x.com/a/123).", "https://x.com/a/123"), ("(https://a.b/Foo_(bar))", "https://a.b/Foo_(bar)"), ("no link", None), (None, None), ("HTTP://A.B/c]]}!", "HTTP://A.B/c"), ("https://a.b/x, https://c.d", "https://a.b/x")],
)
def test_first_url(spark, text, url):
    assert one(spark, T.first_url(F.lit(text).cast("string"))) == url


@pytest.mark.parametrize(("path", "want"), [("a/./b//c", "/a/b/c"), ("/a/../b", "/b"), ("..", None), ("a/../..", None), ("", "/"), ("x" * 4097, None)])
def test_paths(spark, path, want):
    assert one(spark, T.normalize_path(F.lit(path))) == want


def test_names(spark):
    assert one(spark, T.sanitize(F.lit(' a/b:c*?"<>|. '))) == "a_b_c______"
    assert one(spark, T.sanitize(F.lit("..."))) == "media"
    assert one(spark, T.sanitize(F.lit("字" * 100))) == "字" * 60
    assert one(spark, T.sanitize(F.lit("😀" * 100))) == "😀" * 45
    assert one(spark, T.sanitize(F.lit("a" * 200))) == "a" * 120


def test_ids_round_trip(spark):
    for p in ("/", "/ü?>", "/a/b c"):
        id_ = one(spark, T.object_id(F.lit(p)))
        assert not set(id_) & set("+/=") and one(spark, T.object_path(F.lit(id_))) == p


def test_ranges(spark):
    get = lambda h, n: one(spark, T.parse_range(F.lit(h), F.lit(n).cast("long")))
    assert tuple(get("bytes=0-9", 100)) == (0, 9) and tuple(get("bytes=90-200", 100)) == (90, 99) and tuple(get("bytes=-5", 100)) == (95, 99) and tuple(get("bytes=7-", 100)) == (7, 99)
    assert get("bytes=100-", 100) is None and get("bytes=-0", 100) is None and get("x", 100) is None and get("bytes=5-2", 100) is None


@pytest.mark.parametrize(("message", "kind"), [("ENOSPC", "storage"), ("HTTP Error 410: Gone", "refresh"), ("HTTP 404", "permanent"), ("HTTP: 429", "network"), ("Connection reset by peer", "network"), ("permission denied; read timed out", "permanent"), (None, "other")])
def test_error_class(spark, message, kind):
    assert one(spark, T.error_class(F.lit(message).cast("string"))) == kind


def test_window_plan(spark):
    out = windows.plan_windows(spark.range(1), F.lit(1000), 400, 100)
    assert [(r.start, r.stop) for r in out.collect()] == [(0, 400), (300, 700), (600, 1000)]
    assert windows.plan_windows(spark.range(1), F.lit(0), 400, 100).count() == 0
    assert one(spark, windows.even_sample(F.lit(31))) == sorted({round(i * 30 / 29) for i in range(30)})


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        (["the quick brown fox", "brown fox jumps over"], "the quick brown fox jumps over"),
        (["我們去公園", "公園很大"], "我們去公園很大"),
        (["one two", "two three"], "one two two three"),
        ([" ", "alone ", ""], "alone"),
        ([], ""),
        (["你好", "world"], "你好 world"),
    ],
)
def test_seams(spark, parts, want):
    assert one(spark, transcripts.merge_parts(F.array(*map(F.lit, parts)).cast("array<string>"))) == want


def test_captions(spark):
    text = "WEBVTT\nKind: captions\n\n1\n00:00.000 --> 00:02.000\nHello <b>you</b>\n\nNOTE skip\n\n2\n00:02.000 --> 00:03.000\nHello you\n42\n\n00:04.000 --> 00:05.000\n<i></i>\nKind: words"
    out = transcripts.caption_lines(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    assert [r.value for r in out.orderBy("line").collect()] == ["Hello you", "42", "Kind: words"]


MANIFEST = "#EXTM3U\n#EXT-X-TARGETDURATION:10\n" + "#EXT-X-DISCONTINUITY\n".join(f"#EXTINF:10,\ns{i}.ts\n" for i in range(8)) + "#EXT-X-ENDLIST"


def test_playlists(spark):
    df = spark.createDataFrame([(1, MANIFEST)], "k long, t string")
    seg = manifests.segments(df, "k", "t", "https://h/x/l.m3u8")
    assert [(r.segment, r.region, r.seconds, r.url) for r in seg.orderBy("segment").collect()] == [(i, i, 10.0, f"https://h/x/s{i}.ts") for i in range(8)]
    reg = playlist.regions(seg, "k", "segment", "seconds", F.when(F.col("segment") > 0, 1).otherwise(0))
    assert playlist.candidates(reg, "k").count() == 33
    broken = playlist.regions(seg, "k", "segment", "seconds", F.when(F.col("segment") == 4, 2).when(F.col("segment") > 0, 1).otherwise(0))
    assert broken.count() == 9 and playlist.candidates(broken, "k").count() == 20
    found = manifests.checks(df, "k", "t", "https://h/l").first()
    assert (found.segments, found.parsed, found.fingerprint) == (8, True, hashlib.sha256(MANIFEST.encode()).hexdigest())
    assert manifests.regions(df, "k", "t", seg).count() == 8


def test_removed_segments_leave_all_other_lines(spark):
    """Comments, blank lines and line ends between a duration and its URI stay as they stand."""
    text = "#EXTM3U\r\n\r\n  #EXTINF:2, \r\n# why\r\n\r\na.ts \r\n#EXTINF:3,\nb.ts\n\n#EXT-X-ENDLIST"
    df = spark.createDataFrame([(1, text), (2, text)], "k long, t string")
    seg = manifests.segments(df, "k", "t", "https://h/l")
    out = {r.k: r.manifest for r in manifests.without(df, "k", "t", seg.where("k = 1 AND segment = 0")).collect()}
    assert out == {1: "#EXTM3U\r\n\r\n# why\r\n\r\n#EXTINF:3,\nb.ts\n\n#EXT-X-ENDLIST", 2: text}


def test_many_regions_give_their_candidates(spark):
    """A playlist of 1,123 regions of a second has 65,610 candidates of a minute at most."""
    reg = spark.range(1123).select(F.lit(1).alias("k"), F.col("id").alias("region"), F.lit(1.0).alias("seconds"), F.col("id").alias("first_segment"), F.col("id").alias("last_segment"))
    assert playlist.candidates(reg, "k").count() == 65_610


def test_selection(spark):
    rows = [(1, 1, 1, 10.0, 1, 1, 68.0, True), (1, 0, 1, 20.0, 0, 1, 70.0, True), (1, 2, 2, 10.0, 2, 2, 60.0, True), (1, 3, 3, 10.0, 3, 3, 99.0, False), (2, 0, 0, 5.0, 0, 0, 80.0, True)]
    df = spark.createDataFrame(rows, "k long, first_region long, last_region long, seconds double, first_segment long, last_segment long, score double, valid boolean")
    out = playlist.select_disjoint(df, "k")
    assert {(r.k, r.first_region, r.last_region): r.selection for r in out.collect()} == {(1, 1, 1): "overlapped", (1, 0, 1): "selected", (1, 2, 2): "selected", (1, 3, 3): "unknown", (2, 0, 0): "selected"}
    kept = playlist.keep_some(out.withColumn("n", F.when(F.col("k") == 2, 1).otherwise(4)), "k", F.col("n"))
    assert {r.selection for r in kept.where("k = 2").collect()} == {"cleared"} and kept.where("selection = 'selected'").count() == 2


#: Authored vectors: id, scene, gain in dB, text, box, valid, truth, and the score that they must have (fixed values).
BIG, EDGE = (0.2, 0.3, 0.6, 0.2), (0.1, 0.85, 0.8, 0.1)
VECTORS = [
    ("intro", "same", 0, "第一集", BIG, True, "programme", 50.0),
    ("credits", "same", 0, "演員 字幕製作", BIG, True, "programme", 10.0),
    ("logo", "same", 0, "TV", (0.9, 0.02, 0.05, 0.05), True, "programme", 0.0),
    ("overlay", "same", 0, "example.com register", EDGE, True, "programme", 5.0),
    ("volume", "same", 12, "", None, True, "programme", 25.0),
    ("hardcut", "cut", 0, "", None, True, "programme", 7.5),
    ("aba", "aba", 0, "", None, True, "programme", 40.0),
    ("aba-loud-overlay", "aba", 12, "example.com register", EDGE, True, "programme", 70.0),
    ("title-hardcut", "cut", 0, "第一集", BIG, True, "programme", 57.5),
    ("full-ad", "aba", 12, "example.com register", BIG, True, "ad", 100.0),
    ("unverified", "aba", 12, "example.com register", BIG, False, "ad", 100.0),
]


def test_scores(spark):
    scenes = {"same": (0.0, 0.0, 0.0), "cut": (0.2, 0.2, 0.2), "aba": (0.0, 0.2, 0.2)}
    cases = spark.createDataFrame([(v[0], *scenes[v[1]], 100 * 10 ** (v[2] / 20), v[5], v[6]) for v in VECTORS], "id string, j double, b double, e double, rms double, valid boolean, truth string")
    s = scoring.scene_points(F.col("j"), F.col("b"), F.col("e"), [F.lit(0.01), F.lit(1.5)], F.lit(True))
    side = (F.lit(100.0), F.lit(200.0))
    cases = cases.withColumns({"s": s, "a": scoring.audio_points(F.col("rms"), F.lit(1000.0), [side, side])})
    seen = [(v[0], t, v[3], 1.0, *(v[4] or (0.0,) * 4)) for v in VECTORS if v[3] for t in (1.0, 5.0, 9.0)]
    seen = spark.createDataFrame(seen, "id string, time double, text string, confidence double, x double, y double, width double, height double")
    outside = spark.createDataFrame([], "id string, domain string, quality double")
    got = {r.id: r for r in scoring.score(cases, scoring.text_frames(seen, outside)).collect()}
    for name, *_, valid, _, want in VECTORS:
        assert got[name].score == pytest.approx(want, abs=1e-6), name
        assert got[name].decision == ("candidate" if valid and want >= 55 else "unknown")
    assert one(spark, scoring.cannot_pass(F.lit(0.0), F.lit(4.0), 2)) and not one(spark, scoring.cannot_pass(F.lit(0.0), F.lit(5.0), 2))


def test_domains_seen_outside_count_half(spark):
    seen = spark.createDataFrame([("a", 1.0, "EXAMPLE.com", 1.0, 0.0, 0.0, 0.5, 0.5)], "id string, time double, text string, confidence double, x double, y double, width double, height double")
    outside = spark.createDataFrame([("a", "example.com", 1.0)], "id string, domain string, quality double")
    assert scoring.text_frames(seen, outside).first().domain == 0.5


def test_features(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 12)], "v int")
    assert df.agg(features.nearest_rank("v", 0.9).alias("x")).first().x == 10
    assert one(spark, features.mean_absolute_error(F.array(F.lit(0), F.lit(255)), F.array(F.lit(255), F.lit(255)))) == 0.5
    assert one(spark, features.digital_silence(F.array(F.lit(0), F.lit(0)))) and not one(spark, features.digital_silence(F.array().cast("array<int>")))
    spans = spark.createDataFrame([(1, 0.0, 10.0, 0, "a"), (1, 2.0, 5.0, 1, "b"), (1, 3.0, 4.0, 2, "c")], "k int, start double, stop double, depth int, category string")
    assert {r.category: r.seconds for r in features.exclusive_time(spans, "k").collect()} == {"a": 7.0, "b": 2.0, "c": 1.0}


def test_matching(spark):
    ranges = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 4, 6), (1, 3, 7, 9), (1, 4, 0, 100), (2, 5, 0, 9)], "k int, id int, a int, z int")
    assert {(r.id, r.other) for r in matching.overlaps(ranges, "k", "a", "z", "id").collect()} == {(1, 2), (1, 4), (2, 4), (3, 4)}
    points = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 9.0)], "k int, t double")
    gone = spark.createDataFrame([(1, 2.0, 3.0), (1, 5.0, 7.0)], "k int, a double, z double")
    assert sorted((r.t, r.inside, r["shift"]) for r in matching.removed_shift(points, "k", "t", gone, "a", "z").collect()) == [(1.0, False, 0.0), (2.0, True, 0.0), (3.0, False, 1.0), (9.0, False, 3.0)]


def test_queue(spark):
    assert one(spark, queue.selection_toggle(F.array(F.lit(1), F.lit(9)), F.array(F.lit(1), F.lit(2)), F.lit(2))) == [1, 2]
    assert one(spark, queue.selection_toggle(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)), F.lit(2))) == [1]
    assert [one(spark, queue.retry_delay(F.lit(k))) for k in range(1, 6)] == [5, 15, 30, 60, None]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i, (i * 7 % 5) << 20, float(i % 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, size long, seconds double")
    step, start, state, schema = folds.flush_step("user_id", "event_id", "size", "seconds")
    want = sorted(map(tuple, folds.fold_batch(df, "user_id", ["event_id"], step, start, schema).collect()))
    for i in range(4):
        df.where(f"event_id >= {i * 30} AND event_id < {(i + 1) * 30}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = folds.fold_stream(stream, "user_id", ["event_id"], step, start, state, schema)
    q = out.writeStream.format("memory").queryName("flushes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("flushes").collect())) == want and want


def test_unions_keep_their_rows(spark):
    tuned(spark)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
