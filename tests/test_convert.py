"""Script conversion: phrases before the characters in them, from left to right."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import convert


def brute(text, phrases):
    out, at = "", 0
    while at < len(text):
        found = max((p for p in phrases if text.startswith(p, at)), key=len, default=None)
        out += phrases[found] if found else text[at]
        at += len(found) if found else 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_longest_phrases_first(spark, seed):
    rng = random.Random(seed)
    phrases = {"".join(rng.choice("软件发abc") for _ in range(rng.randint(1, 4))): rng.choice(["", "軟體", "x"]) for _ in range(12)}
    texts = ["".join(rng.choice("软件发abc d") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", convert.converted(F.col("t"), phrases).alias("c")).collect()
    assert all(r.c == (None if r.t is None else brute(r.t, phrases)) for r in rows)


def test_dictionaries_are_checked(spark):
    table = lambda rows: spark.createDataFrame(rows, "source string, target string")
    assert convert.dictionary(table([("a", "b"), ("a", "b")])) == {"a": "b"} and convert.dictionary(table([])) == {}
    for bad in ([("", "b")], [("a", "b"), ("a", "c")], [(None, "b")], [("a", None)]):
        with pytest.raises(ValueError):
            convert.dictionary(table(bad))
