"""Phrases: what the shards exchange, and results where buckets are few."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_llm_round3 import ROWS, brute_phrases

from sparkloom.llm import common, phrases

SCHEMA = "doc_id long, text string, lang string"


def rare_texts():
    """Frequent words in pairs that are frequent and triples that are not, and one frequent phrase."""
    rng = random.Random(5)
    return [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(300)) + ". once upon a time there", "en") for i in range(30)]


def test_phrases_send_only_what_may_be_frequent(spark, monkeypatch):
    rows, sent, staged = rare_texts(), [], common.staged

    def counted(df, label, paths=None):
        out = staged(df, label, paths)
        if label == "phrases-round-3":
            sent.append(sum(len(r.n) // 4 for r in out.where("keys IS NOT NULL").collect()))
        return out

    monkeypatch.setattr(common, "staged", counted)
    phrases.count_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), 30, size=400)
    f = Counter()
    for _, t, _ in rows:
        for piece in t.split("."):
            w = piece.split()
            f.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    good = sum(n for n in f.values() if n >= 30)
    assert sent and 0 < sent[0] <= good < len(f) / 10  # a count for each place at most, of frequent phrases alone


@pytest.mark.parametrize("bits", [12, 16])
def test_phrases_with_few_buckets(spark, bits):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    totals, known, found = phrases.count_phrases(docs, 5, size=64, bits=bits)
    _, known32, found32 = phrases.count_phrases(docs, 5, size=64)
    names = {r.number: (r.lang, r.word) for r in known.collect()}
    names32 = {r.number: (r.lang, r.word) for r in known32.collect()}
    spelled = lambda rows, names: sorted((tuple(names[x] for x in r.g), r.a) for r in rows.collect())
    assert spelled(found, names) == spelled(found32, names32)
    assert {r.lang: r.n for r in totals.collect()} == {p[0]: p[6] for p in brute_phrases(ROWS, 5, 100, 10**6)}
