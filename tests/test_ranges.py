"""Byte ranges of documents without text, of unknown size and with negative numbers."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import text as T


def test_http_range_of_odd_documents_equals_its_sql(spark, tmp_path):
    sizes = (None, -5, 0, 1, 10, 11, 99, 100, 499, 500, 501, 2**40)
    rows = [(k, n) for k in (None, *range(-3, 3), 2**31, 2**31 + 1, 2**31 + 2) for n in sizes]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["http_range"](spark, str(tmp_path)).collect()
    want = db.sql(registry.oracle_sql()["http_range"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_resources_serve_their_last_bytes_only_if_asked(spark):
    def get(header, size, **more):
        found = T.parse_range(F.lit(header).cast("string"), F.lit(size).cast("long"), **more)
        row = spark.range(1).select(found.alias("r")).head().r
        return row and tuple(row)

    assert get("bytes=-5", 0) is None and get("bytes=-5", None) is None
    assert get("bytes=-5", 0, empty=True) == (0, -1) and get("bytes=-5", None, empty=True) == (0, None) and get("bytes=-5", 9, empty=True) == (4, 8)
    for header in ("bytes=-0", "bytes=0-", "bytes=0-9", "bytes=-", "x", None):
        assert get(header, 0, empty=True) is None
