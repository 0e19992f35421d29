"""What the third round's findings are about, each in a small case."""

from __future__ import annotations

import base64
import random

from pyspark.sql import functions as F

from sparkloom import registry, session
from sparkloom.functions import text as T
from sparkloom.operators import features

SF = "/root/testdata/sf0.001"


def test_ids_of_long_paths_stand_in_one_line(spark):
    paths = ["x" * n for n in (56, 57, 58, 61, 200)]
    id_ = T.object_id(F.col("path"))
    for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", id_.alias("id"), T.object_path(id_).alias("back")).collect():
        assert r.id == base64.urlsafe_b64encode(r.path.encode()).decode().rstrip("=")
        assert r.back == r.path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_observations_of_a_case_are_read_once(spark):
    found = plan(registry.queries()["document_scores"](spark, SF))
    assert 0 < found.count("normalize_text(") <= 2  # for the filter and for what follows


def test_payloads_of_a_journal_are_parsed_once(spark):
    for name in ("journal_restore", "valid_prefix"):
        assert plan(registry.queries()[name](spark, SF)).count("parse_json") + plan(registry.queries()[name](spark, SF)).count("parseJson") == 1


def test_area_of_many_rectangles_without_joins(spark):
    rng = random.Random(5)
    rects = [(k, *sorted(rng.choices(range(9), k=2)), *sorted(rng.choices(range(9), k=2)), rng.choice([0.0, 0.5, 1.0, 2.0])) for k in range(12) for _ in range(k)]
    rows = spark.createDataFrame([(k, float(a), float(c), float(b), float(d), w) for k, a, b, c, d, w in rects], "k int, x0 double, y0 double, x1 double, y1 double, weight double")
    want = {}
    for k in {r[0] for r in rects}:
        whole = [r for r in rects if r[0] == k and r[1] < r[2] and r[3] < r[4] and r[5] > 0]
        if whole:
            want[k] = sum(max((w for _, a, b, c, d, w in whole if a <= x < b and c <= y < d), default=0.0) for x in range(9) for y in range(9))
    found = features.rect_union(rows, "k")
    assert {r.k: r.area for r in found.collect()} == want
    assert "Join" not in plan(found)


def test_packets_are_fingerprinted_once(spark):
    assert plan(registry.queries()["kept_media"](spark, SF)).count("MapInArrow") == 1


def test_whole_texts_do_not_go_to_python_in_batches_of_ten_thousand(spark):
    found = plan(registry.queries()["converted_texts"](spark, SF))
    assert "ArrowEvalPython" not in found and "BatchEvalPython" in found


def test_a_task_after_a_shuffle_stays_small(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for given, want in (("64MB", 8 << 20), ("1g", 8 << 20), ("4m", 4 << 20), ("16k", 16 << 10), ("67108864b", 8 << 20)):
            spark.conf.set(name, given)
            assert session._bytes(session.tuned(spark).conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
