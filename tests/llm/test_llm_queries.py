"""Registered queries against their SQL, and the shape of the others."""

from __future__ import annotations

import duckdb
import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return "" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted([plain(r[c]) for c in order] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
