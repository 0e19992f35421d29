"""Phrases, packing and spelling variants against brute force, over awkward tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import kernels as K
from sparkloom.llm import licenses, packing, phrases, spelling
from sparkloom.llm.automaton import Automaton
from sparkloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "d\x00lta", "e", "ζeta", "e ta", "Thing"]
    out = [None, "", " \t ", ".,;:!?\n\r\x0b", "one", "a  b\tc", "a,b;c", "alpha beta " * 400, "x" * 3000, "Alpha Beta\n" * 60, "ÿÿÿÿÿÿÿÿ× ÷abcdefgh"]
    for _ in range(60):
        n = rng.choice([1, 3, 20, 200])
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(n)))
    return out + [out[15], out[15], out[20]]


ROWS = [(i // 2 * 3 - 6 if i != 9 else None, t, [None, "en", "und", "fr"][i % 4]) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(1).alias(c) for c in ("n", "word", "g", "part", "shard", "ids", "block", "length", "a.b")]
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).select("*", *extra).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_phrases(rows, least, inside, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        good = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in good.items():
            holds = (o for o in good if len(o) > len(g) and any(o[i : i + len(g)] == g for i in range(len(o))))
            if any(100 * good[o] >= inside * a for o in holds):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r))
        for i, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "inside", "top", "size"), [(100, 100, 2000, 1 << 21), (5, 100, 2000, 64), (3, 60, 7, 9), (2, 100, 50, 5)])
def test_phrases(spark, docs, least, inside, top, size):
    found = phrases.collocations(docs, least, inside, top, size=size)
    assert sorted(map(tuple, found.collect())) == brute_phrases(ROWS, least, inside, top)


def test_phrases_of_nothing(nothing):
    assert phrases.collocations(nothing).count() == 0


def test_long_texts_are_cut_in_steps(monkeypatch):
    monkeypatch.setattr(phrases, "_STEP", 50)
    text = "".join(t or "" for t in texts()).encode()
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, 500, 500, len(text)])
    got = [(p[0].tobytes(), *map(list, p[1:])) for p in phrases._words(data, bounds)]
    monkeypatch.setattr(phrases, "_STEP", 1 << 30)
    whole = [(p[0].tobytes(), *map(list, p[1:])) for p in phrases._words(data, bounds)]
    assert b"".join(x[0] for x in got) == whole[0][0]
    assert all(sum((x[i] for x in got), []) == whole[0][i] for i in (1, 2, 3))


def test_products_beyond_64_bits(spark):
    sql = "(1000 * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"
    a, n, l, r = 10**12 + 7, 10**14 + 9, 10**13 + 1, 10**12 + 39
    assert spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{sql} AS x").first().x == 1000 * a * n // (l * r)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(50):
        code = rng.integers(0, 4, rng.integers(0, 60))
        order = phrases.suffix_array(code, 5)

        def prefix(p, code=code):
            w = code[p : p + 5].tolist()
            return w[: w.index(0)] if 0 in w else w

        keys = [prefix(p) for p in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(code).tolist()
        for m in range(1, 6):
            at, head = phrases.intervals(code, m)
            grams = Counter(tuple(code[p : p + m].tolist()) for p in range(len(code) - m + 1) if 0 not in code[p : p + m])
            assert {tuple(code[p : p + m].tolist()): n for p, n in zip(at[head], np.diff(np.append(head, len(at))), strict=True)} == grams


@pytest.mark.parametrize("capacity", [1024, 64, 8, 1, 48])
def test_packing(spark, docs, nothing, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), capacity).cache()
    got = pieces.collect()
    want = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t, _ in ROWS)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in got:
        assert len(p.ids) == 2 * p.length and p.length > 0
        wide = np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()
        assert zlib.crc32(wide) == p.ids_crc32
        by_seq[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append((p.start, wide))
    # documents with equal ids and sizes are told apart by content only: compare all bytes by place
    held = Counter()
    for (i, n), parts in by_doc.items():
        for start, wide in parts:
            held.update((i, n, start + k, wide[4 * k : 4 * k + 4]) for k in range(len(wide) // 4))
    expected = Counter()
    for (i, ids), times in want.items():
        for k in range(len(ids) // 4):
            expected[i, len(ids) // 4, k, ids[4 * k : 4 * k + 4]] += times
    assert held == expected
    total = sum(len(x[1]) // 4 * n for x, n in want.items())
    sizes = []
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and sum(sizes) == total and max(sizes) <= capacity
    padded = sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)
    assert padded == 0 if capacity & (capacity - 1) == 0 else padded < capacity
    whole = packing.sequences(pieces).collect()
    assert sorted(s.tokens for s in whole) == sorted(sizes)
    for s in whole[:50]:
        own = sorted((p for p in got if p.sequence_id == s.sequence_id), key=lambda p: p.offset)
        assert bytes(s.ids) == b"".join(bytes(p.ids) for p in own) and [x.doc_id for x in s.pieces] == [p.doc_id for p in own]
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_packing_plans():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([1, 4, 16, 64])
        histogram = {rng.randint(1, capacity): rng.choice([1, 2, 7, 1000, 10**9]) for _ in range(rng.randint(0, 9))}
        plan = packing.shortest_pack_first(histogram, capacity)
        assert len(plan.key) <= capacity**2 + 2 * capacity + 16
        assert sum(n * length for length, n in histogram.items()) == sum(_many(plan, histogram).values())


def _many(plan, histogram):
    """Tokens by line, each line holding the ranks up to the next line of its length or to the end of the length."""
    count = Counter(histogram)
    out = {}
    for i in reversed(np.argsort(plan.key >> packing.RANK_BITS, kind="stable").tolist()):
        length, first = int(plan.key[i]) >> packing.RANK_BITS, int(plan.key[i]) & ((1 << packing.RANK_BITS) - 1)
        same = [int(k) & ((1 << packing.RANK_BITS) - 1) for k in plan.key if int(k) >> packing.RANK_BITS == length]
        later = [x for x in same if x > first]
        out[i] = (length, first, later)
    total = {}
    for length in sorted({x[0] for x in out.values()}, reverse=True):
        for i, (own, first, later) in out.items():
            if own == length:
                n = (min(later) if later else count[length]) - first
                total[i] = n * int(plan.taken[i])
                if plan.taken[i] < length:
                    count[length - int(plan.taken[i])] += n
    return total


def brute_variants(rows, drop, least, times):
    counts = Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    return forms({w: n for w, n in counts.items() if n >= 2}, times)


def forms(n, times):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


def letter_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))) for _ in range(25)]
    rows = list(ROWS)
    for i in range(120):
        w = [rng.choice(base) if rng.random() < 0.7 else rng.choice(base)[:-1] + rng.choice("abcÉ") for _ in range(30)]
        rows.append((i, " ".join(w), "en"))
    return [*rows, (None, "Abcdefgh " * 31, None), (7, "abcdefgh×÷ÿ" * 40, None), (1, "q" * 2000 + " " + "q" * 1999 + " " + "q" * 2000 + " " + "q" * 1999, None)]


@pytest.mark.parametrize(("drop", "least", "times"), [(31, 7, 10), (3, 7, 2), (5, 3, 3)])
def test_spelling_variants(spark, nothing, drop, least, times):
    rows = letter_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("n", "word", "root", "key")})
    got = spelling.spelling_variants(docs, drop, least, times).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_variants(rows, drop, least, times)
    assert spelling.spelling_variants(nothing).count() == 0


@pytest.mark.parametrize(("parts", "block"), [(2, 1 << 14), (7, 3), (40, 1)])
def test_variants_of_dense_vocabularies(spark, parts, block):
    rng = random.Random(parts)
    n = {"".join(rng.choice("ab漢") for _ in range(rng.randint(1, 6))): rng.choice([1, 1, 5, 40, 300]) for _ in range(300)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), 4, parts, block).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(n) and {tuple(r) for r in got} == forms(n, 4)


def test_long_runs_are_cut_in_steps(monkeypatch):
    text = " ".join(r[1] or "" for r in letter_rows()).encode()
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, 700, 701, len(text)])
    whole = list(spelling._runs([1, None, 3], data, bounds, 5, 7))
    monkeypatch.setattr(spelling, "_STEP", 61)
    steps = list(spelling._runs([1, None, 3], data, bounds, 5, 7))
    assert b"".join(x[0].tobytes() for x in steps) == whole[0][0].tobytes() and np.concatenate([x[1] for x in steps]).tolist() == whole[0][1].tolist()


def test_checksums():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = np.sort(rng.choice(4000, 60, replace=False))
    ends = starts + rng.integers(0, 400, 60)
    before = np.array([zlib.crc32(bytes([i])) for i in range(60)], np.uint32)
    want = [zlib.crc32(data[a:z].tobytes(), int(b)) for a, z, b in zip(starts, ends, before, strict=True)]
    assert spelling.crc32(data, starts, ends, before).tolist() == want


def test_automata_are_minimal_and_number_their_words():
    def packed(words):
        return np.array([ord(c) for w in words for c in w], np.int64), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    for seed in range(60):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 60))})
        a = Automaton(*packed(words))
        assert a.numbers(*packed(words)).tolist() == list(range(len(words)))
        assert (a.numbers(*packed(["d", "abcabcabc", "aad"])) == -1).all()
        known = {0: frozenset()}
        for e in range(1, a.size + 1):  # targets and following edges have smaller numbers
            below = {chr(a.letter[e]) + x for x in known[int(a.child[e])]} | ({chr(a.letter[e])} if a.final[e] else set())
            known[e] = frozenset(below) | known[int(a.next[e])]
        assert len(set(known.values())) == a.size + 1


def test_blanks_and_splitters():
    assert not phrases._WORD[[9, 10, 11, 12, 13, 32, *map(ord, ".,;:!?")]].any() and phrases._WORD[[0, 28, 160, 255]].all()
    assert K.LOWER[ord("Z")] == ord("z")


def test_license_notices_repeated_in_a_long_text(spark, monkeypatch):
    notice = "Released under the MIT License.\n"
    monkeypatch.setattr(licenses, "STEP", 16)
    rows = [(1, notice * 12000), (1, notice * 12000), (None, notice), (None, None), (2, "x " * 300 + notice + "y " * 300), (3, notice * 40 + "z")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_matches, r.licenses) for r in out) == [("1", 12000, "MIT"), ("1", 12000, "MIT"), ("2", 1, "MIT"), ("3", 40, "MIT"), ("None", 0, ""), ("None", 1, "MIT")]
    assert [m.start for m in next(r for r in out if r.doc_id == 3).matches] == list(range(0, 200, 5))
