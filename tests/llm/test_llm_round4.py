"""What round 4 mended: pairs of near copies, labels between comparisons."""

import random

import brute
from sparkloom.llm import common, neardup
from sparkloom.llm.components import merged


def test_crowd_of_near_copies_needs_few_pairs(spark, monkeypatch):
    """Copies with two to four changed words of their own link with the one nearest to their text, not with each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for d in range(1, 301):
        words = list(base)
        for i in rng.sample(range(120), rng.randint(2, 4)):
            words[i] = f"x{d}_{i}"
        rows.append((d, " ".join(words)))
    compared, staged = [], common.staged

    def counted(df, label, paths=None):
        out = staged(df, label, paths)
        if label == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(common, "staged", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(brute.near_duplicates(rows))
    assert sum(compared) < 56 * len(rows), compared


def test_merged_joins_a_hub_with_its_neighbours(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 7), (8, 7)], "node long, comp long")
    links = spark.createDataFrame([(5, 8), (5, 2), (5, 9), (3, 4)], "u long, v long")
    got = {r.node: r.comp for r in merged(labels, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 7: 1, 8: 1, 9: 1, 3: 3, 4: 3}
    assert merged(labels.limit(0), links.limit(0)).count() == 0
