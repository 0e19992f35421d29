from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import kernels as K
from sparkloom.llm import suffix_dedup, suffixes
from sparkloom.llm.encoder import encoder, pieces
from sparkloom.llm.neardup import shingle_sets
from sparkloom.llm.queries import tokenizer_path

texts = st.lists(st.text(alphabet="ab Zé\n\t.0😀  \x1c'’", max_size=40), min_size=1, max_size=6)


def block(rows):
    column = pa.array(rows, pa.string())
    return next(iter(K.blocks(column, 1 << 30)))[1:3]


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([1, 3, 7, 1 << 20]))
def test_words_match_regular_expressions(rows, size):
    data, bounds = block(rows)
    old, K.SLICE = K.SLICE, size
    try:
        for inside, pattern, change in ((~K.BLANK, brute.BLANK, lambda r: r), (K.ALNUM, brute.ALNUM, brute.lower)):
            changed = K.LOWER[data] if inside is K.ALNUM else data
            got = K.words(changed, bounds, inside)
            found = [changed[a:z].tobytes().decode() for a, z in zip(*got, strict=True)]
            assert found == [w for r in rows for w in pattern.findall(change(r))]
            assert K.counts(got[0], bounds).tolist() == [len(pattern.findall(change(r))) for r in rows]
    finally:
        K.SLICE = old


@settings(max_examples=150, deadline=None)
@given(texts)
def test_pieces_encode_alone_as_in_their_text(rows):
    enc = encoder(tokenizer_path())
    data, bounds = block(rows)
    ids, at = enc.encode(data, bounds)
    for r, a, z in zip(rows, at[:-1], at[1:], strict=True):
        assert ids[a:z].tolist() == enc.library.encode(r, add_special_tokens=False).ids
    starts, length = enc.lengths(data, bounds)
    assert length.sum() == len(ids) and starts.tolist() == pieces(data, bounds).tolist()


def test_encoder_forgets_and_goes_on():
    enc = encoder(tokenizer_path())
    data, bounds = block(["One two  three\n\nfour <|endoftext|> five", ""])
    first = enc.encode(data, bounds)[0].tolist()
    enc.clear()
    assert enc.encode(data, bounds)[0].tolist() == first == enc.library.encode("One two  three\n\nfour <|endoftext|> five", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(texts)
def test_shingle_sets_count_distinct_shingles(rows):
    data, bounds = block(rows)
    assert shingle_sets(data, bounds, 3)[2].tolist() == [len(brute.shingles(r, 3)) for r in rows]


@pytest.mark.parametrize("seed", range(40))
def test_suffix_sort_against_sorting(seed):
    rng = random.Random(seed)
    depth = rng.choice([3, 8, 20])
    strings = [bytes(rng.choice(b"ab" if seed % 2 else b"abcd ") for _ in range(rng.randint(depth, 60))) for _ in range(rng.randint(1, 6))]
    strings += [b"a" * 50, b"a" * 40 + b"b"] if seed % 5 == 0 else []
    wanted = [len(s) - depth + 1 for s in strings]
    b = suffixes.Block(strings, wanted, depth)
    text = {int(b.begin[i]) + j: s[j : j + depth] for i, s in enumerate(strings) for j in range(wanted[i])}
    order = b.sort().tolist()
    assert sorted(order) == sorted(text)
    assert [text[x] for x in order] == sorted(text.values())
    all_ = list(text.values())
    assert {x for x in np.flatnonzero(b.repeated()).tolist()} == {x for x, v in text.items() if all_.count(v) > 1}


def test_anchors_own_every_string_once_and_by_content(monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [base[:1500], "x" * 700 + base[200:1200] + "y" * 500, "", "short", base[1000:], "z" * 2000]
    data, bounds = block(rows)
    runs = lambda: sorted((a + lo, n, h) for lo, _, first, many, _, hashes in suffix_dedup.anchors(data, bounds, 400) for a, n, h in zip(first.tolist(), many.tolist(), hashes.tolist(), strict=True))
    whole = [runs()]
    monkeypatch.setattr(K, "SLICE", 1000)
    whole.append(runs())
    owners = []
    for found in whole:
        owner = {}
        for at, many, h in found:
            for s in range(at, at + many):
                assert s not in owner
                owner[s] = h
        owners.append(owner)
    assert owners[0] == owners[1]
    valid = {s for a, z in zip(bounds[:-1], bounds[1:], strict=True) for s in range(a, z - 399)}
    assert set(owners[0]) == valid
    by_text = {}
    for s, h in owners[0].items():
        assert by_text.setdefault(data[s : s + 400].tobytes(), h) == h


def test_pieces_hold_every_string_once_and_by_core():
    rng = random.Random(6)
    base = "".join(rng.choice("abc ") for _ in range(2500))
    data, bounds = block([base + base[300:1400] + "end"])
    for width in (128, 32, 8, 2, 1):
        seen, cores, kinds = set(), {}, {}
        for lo, part, first, many, anchor, h in suffix_dedup.anchors(data, bounds, 400):
            run, start, n, off, key, kind = suffix_dedup.cut(part, first, many, anchor - first, h, 400, width)
            assert (off + start == anchor[run]).all() and (n >= 1).all()
            for s, m, o, k, x in zip((start + lo).tolist(), n.tolist(), off.tolist(), key.tolist(), kind.tolist(), strict=True):
                assert m <= width and not seen & set(range(s, s + m))
                seen |= set(range(s, s + m))
                core = s + o - o // width * width
                assert cores.setdefault(k, data[core : core + 401 - width].tobytes()) == data[core : core + 401 - width].tobytes()
                assert kinds.setdefault(x, data[s : s + m + 399].tobytes()) == data[s : s + m + 399].tobytes()
        assert seen == set(range(len(data) - 399))
