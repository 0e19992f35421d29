"""Page tokens, the script lexer and addresses over awkward texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import pages


def read(html):
    return [(t[0], t[1] or t[3], t[4], t[5]) for t in pages._read(html)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("a<b>c</b>d", [("text", "a", -1, 1), ("open", "b", -1, 3), ("text", "c", 1, 3), ("text", "d", -1, 4)]),
        ("<p>x<p>y", [("open", "p", -1, 4), ("text", "x", 0, 2), ("open", "p", 0, 4), ("text", "y", 2, 4)]),
        ("<div><a>x</div>y", [("open", "div", -1, 3), ("open", "a", 0, 3), ("text", "x", 1, 3), ("text", "y", -1, 4)]),
        ("</b>x<br>y<i/>z", [("text", "x", -1, 1), ("open", "br", -1, 2), ("text", "y", -1, 3), ("open", "i", -1, 4), ("text", "z", -1, 5)]),
        ("<!-- <a> --><!DOCTYPE x>1 < 2", [("text", "1 < 2", -1, 1)]),
        ("<script>if(a<b){'</i>'}</script><style>x", [("open", "script", -1, 2), ("raw", "script", 0, 2), ("open", "style", -1, 3), ("text", "x", -1, 4)]),
        ('<a title="x > y" href=\'q\'>t</a>', [("open", "a", -1, 2), ("text", "t", 0, 2)]),
        ("&#x41;&amp;lt;&#55555555;", [("text", "A&lt;&#55555555;", -1, 1)]),
    ],
)
def test_tokens(html, want):
    assert read(html) == want


def test_attributes():
    assert pages._read("<A HREF='a&amp;b' x=1 data-X=\" y \" href=\"last\">")[0][2] == [("href", "a&b"), ("data-x", "y"), ("href", "last")]


def test_tokens_of_null_and_repeated_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<b>x</b>"), (3, "<b>x</b>")], "id long, html string")
    assert pages.tokens(rows, "id", "html").groupBy("key").count().collect() == [(3, 4)]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("var p = {a: {b: 1}}; p={}", ["{a: {b: 1}}", "{}"]),
        ("p='{'; q={}; p /* = {} */ = // {\n {'}': \"}\", /* } */ c: `}`}", ["{'}': \"}\", /* } */ c: `}`}"]),
        ("'p={}'; // p={}\n /* p={} */ xp={}; p.x={}; p=={}", []),
        ('p={"a":"}', []),
        ("p={'\\'}': 1}", ["{'\\'}': 1}"]),
        ("p={{}", []),
    ],
)
def test_script_objects(spark, code, want):
    row = spark.createDataFrame([([code, "p = {}"],), (None,), ([],)], "b array<string>").select(pages.script_objects(F.col("b"), "p").alias("o"))
    assert [r.o for r in row.collect()] == [[*want, "{}"], None, []]
