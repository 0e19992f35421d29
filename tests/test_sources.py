"""Parsers and text functions on literal inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import udfs
from sparkloom.sources import media


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("ＥＸＡＭＰＬＥ . Com", "example.com"), ("Tradução", "traducao"), (None, None)])
def test_normalize(spark, text, want):
    assert one(spark, udfs.normalize_text(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Pi is 3.14 ok. Next", "Pi is 3.14 ok.\nNext"), ("see example.com now! Yes", "see example.com now!\nYes"), ("v1.2.3 is out", "v1.2.3 is out"), ("你好。再見！", "你好。\n再見！"), ("", ""), (None, None)],
)
def test_line_breaks(spark, text, want):
    assert one(spark, udfs.break_lines(F.lit(text).cast("string"))) == want


def test_long_lines_are_wrapped(spark):
    got = one(spark, udfs.break_lines(F.lit("word " * 40))).split("\n")
    assert max(map(len, got)) <= 42 and "".join(got).replace(" ", "") == "word" * 40


def test_scripts(spark):
    assert one(spark, udfs.unescape_script(F.lit("a+b%20%u4f60%zz"))) == "a+b 你%zz"
    assert one(spark, udfs.json_object_at(F.lit('x={"a":"}{"};y'), F.lit(2))) == '{"a":"}{"}'
    assert one(spark, udfs.json_object_at(F.lit("x={"), F.lit(2))) is None
    assert one(spark, udfs.canonical_json(F.lit('{"b":1,"a":[1, 2]}'))) == '{"a":[1,2],"b":1}'
    assert one(spark, udfs.canonical_json(F.lit("{"))) is None


def test_items_without_formats_are_dropped(spark):
    df = spark.createDataFrame([(1, '{"id":"x","extractor_key":"k"}'), (2, '{"title":"t","url":"http://h/p.webp?x=1"}'), (3, "not json"), (4, None)], "k int, info string")
    got = media.media_items(df, "k", "info").collect()
    assert [(r.k, r.position, r.id, r.title, r.is_image, r.formats[0].ext) for r in got] == [(2, None, "", "t", True, "webp")]


@pytest.mark.parametrize(
    ("line", "want"),
    [('progress:{"status":"downloading","downloaded_bytes":5,"total_bytes":20}', ("DOWNLOADING", 0.25)), ('progress:{"status":"downloading"}', ("DOWNLOADING", -1.0)), ('progress:{"status":"finished"}', ("PROCESSING", None)), ("progress:[]", None), ("other", None)],
)
def test_progress(spark, line, want):
    got = one(spark, media.progress(F.lit(line)))
    assert (got and (got.phase, got.fraction)) == want


def test_rates(spark):
    get = lambda a, u: one(spark, media.rate(F.lit(a), F.lit(u)))
    assert (get("1.5", 1000000), get(" ,5 ", 1000), get("0.0001", 1000), get("0", 1), get("1e3", 1), get("99999999999999999999", 1000000)) == (1500000, 500, None, None, None, None)


def test_types(spark):
    assert one(spark, media.mime_type(F.lit("MKV"))) == "video/x-matroska" and one(spark, media.mime_type(F.lit("x"))) == "application/octet-stream"
    assert one(spark, media.extension(F.lit("https://a.b/c.d/e.TS?x=.mp4#f.g"))) == "ts" and one(spark, media.extension(F.lit("https://a.b/c"))) == ""
    assert one(spark, media.image_kind(F.unhex(F.lit("FFD8FF")))) == "jpg" and one(spark, media.image_kind(F.unhex(F.lit("00")))) is None
