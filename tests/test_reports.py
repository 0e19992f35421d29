"""Published tables: pushed filters, writers that fail, and reports in and out."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import reports

ROWS = [(i, f"p{i % 3}/{i}" if i % 7 else None, i / 2 if i % 5 else None) for i in range(40)]
SCHEMA = "id long, path string, size double"


@pytest.fixture
def folder(spark, tmp_path):
    where = f"file://{tmp_path}/table"
    reports.publish(spark.createDataFrame(ROWS, SCHEMA).repartitionByRange(4, "id"), where)
    return where


@pytest.mark.parametrize("where", ["id > 30", "id = 7", "id IN (1, 2, 99)", "path LIKE 'p1/%'", "path IS NULL", "NOT (id = 7)", "path NOT IN ('p1/1')", "size >= 3.5 AND size < 9", "path IS NOT NULL AND id <= 3", "upper(path) = 'P1/1'", "size = 2 OR id = 9"])
def test_filters_are_pushed_and_right(spark, folder, where):
    got = reports.published(spark, folder).where(where)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, spark.createDataFrame(ROWS, SCHEMA).where(where).collect()), key=str)


def test_the_plan_has_the_pushed_filter(spark, folder):
    plan = reports.published(spark, folder).where("id > 30 AND upper(path) = 'P1/31'")._jdf.queryExecution().executedPlan().toString()
    assert "upper" in plan.lower() and "(id" not in "".join(line for line in plan.splitlines() if "Filter" in line and "upper" not in line)
    reader = reports._Reader(folder, reports.published(spark, folder).schema)
    left = list(reader.pushFilters([reports.D.GreaterThan(("id",), 30), reports.D.StringContains(("path",), "x")]))
    assert [type(f).__name__ for f in left] == ["StringContains"] and len(reader.partitions()) == 1


def test_a_failed_writer_leaves_what_was_there(spark, folder, tmp_path):
    before = sorted(map(tuple, reports.published(spark, folder).collect()), key=str)
    broken = spark.range(40).repartition(4).select("id", F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("path"), F.lit(1.0).alias("size"))
    with pytest.raises(Exception, match="broken"):
        reports.publish(broken, folder)
    assert sorted(map(tuple, reports.published(spark, folder).collect()), key=str) == before
    with pytest.raises(Exception, match="published"):
        reports.publish(spark.createDataFrame(ROWS[:3], SCHEMA), folder, replace=False)
    reports.publish(spark.createDataFrame(ROWS[:3], SCHEMA), folder)
    assert reports.published(spark, folder).count() == 3
    reports.publish(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", replace=False)
    assert reports.published(spark, f"file://{tmp_path}/none").count() == 0


def test_reports_in_and_out(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"policy": "x", "cases": [{"id": "a", "n": 1}, {"id": "b"}]}))
    cases = reports.read_cases(spark, f"{tmp_path}/a.json", "id string, n long")
    assert [tuple(r.case) for r in cases.orderBy("place").collect()] == [("a", 1), ("b", None)]
    for i, bad in enumerate(["[]", '{"cases": {}}', '{"cases": [1]}', "{", "{}"]):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(Exception, match="cases array"):
            reports.read_cases(spark, f"{tmp_path}/bad{i}.json", "id string").collect()
    rows = spark.range(2).select(F.col("id").cast("string").alias("id"), *(F.lit(1.5).alias(c) for c in reports.REVIEW[1:10]), F.lit("unknown").alias("decision"), F.lit("preserve").alias("action"))
    reports.write_report(rows, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/review").columns == list(reports.REVIEW) and spark.read.json(f"{tmp_path}/out/report").count() == 2
    with pytest.raises(Exception, match="EXISTS"):
        reports.write_report(rows, f"{tmp_path}/out")
