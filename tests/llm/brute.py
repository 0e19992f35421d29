"""Plain, slow versions of the operators' contracts, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str | None) -> str:
    return (text or "").translate(UPPER)


def token_ids(rows, tokenizer, end_id=0):
    """rows: (doc_id, text), ids distinct and not null."""
    out, start = [], 0
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def decontaminate(rows, items, window=13):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i : i + n])].add(item or "")
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def shingles(text, k=5):
    w = BLANK.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, k=5, percent=75):
    """doc_id, n_shingles, component_id, kept; ids distinct and not null."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists, n_shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    for ds in lists.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                n_shared[a, b] += 1
    for (a, b), n in n_shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def repeats(rows, size=400):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    starts = defaultdict(list)
    data = [(d, (t or "").encode()) for d, t in rows]
    for i, (_, b) in enumerate(data):
        for s in range(len(b) - size + 1):
            starts[b[s : s + size]].append((i, s))
    covered = [np.zeros(len(b), bool) for _, b in data]
    for where in starts.values():
        if len(where) > 1:
            for i, s in where:
                covered[i][s : s + size] = True
    out = []
    for (d, b), c in zip(data, covered, strict=True):
        edges = np.diff(np.concatenate([[0], c.astype(np.int8), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        out.append((d, len(b), int(c.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def mix_targets(rows, weights=(5, 2, 1), share=1.5, most=2):
    """rows: (source, size). The level at which capped shares add up, by bisection."""
    size = defaultdict(int)
    for s, n in rows:
        size[s] += n
    order = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, lo, hi = share * sum(size.values()), 0.0, 1e18
    for _ in range(300):
        level = (lo + hi) / 2
        lo, hi = (lo, level) if sum(min(most * size[s], level * weight[s]) for s in size) > goal else (level, hi)
    return {s: min(most * size[s], lo * weight[s]) for s in size}


def tilted_rates(sizes, target, most=2):
    """min(most, exp(x * size)) with x such that the expected words are the target, by bisection."""
    x = np.array(sizes, float)
    lo, hi = -1e3, 1e3
    for _ in range(300):
        at = (lo + hi) / 2
        with np.errstate(over="ignore"):
            rate = np.minimum(most, np.exp(at * x))
        lo, hi = (at, hi) if (rate * x).sum() < target else (lo, at)
    return rate.tolist()
