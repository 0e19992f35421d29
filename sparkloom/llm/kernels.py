"""Vectorised byte kernels shared by the text operators.

They work on blocks of UTF-8 documents laid end to end, as Arrow stores them: ``data`` is a uint8 array and ``bounds``
holds the n + 1 document borders. Every kernel goes through its input in slices of about ``SLICE`` bytes, so the
temporaries stay a small multiple of that, however long a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(SLICE + 4096, n)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(of: str) -> np.ndarray:
    """Truth table over byte values for a class given as Latin-1 characters."""
    out = np.zeros(256, bool)
    out[list(of.encode("latin-1"))] = True
    return out


#: Bytes that separate words of ``[^\x20\x09-\x0D]+``.
BLANK = table(" \t\n\x0b\x0c\r")
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds, null flags) over runs of rows of up to ``limit`` bytes; a longer row comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    nulls = np.asarray(column.is_null())
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first], nulls[first:last]
        first = last


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in class ``inside``; no run crosses a border."""
    starts, ends = [], []
    n = len(data)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        # one byte more on either side tells whether a run goes on there
        here = inside[data[max(0, lo - 1) : min(n, hi + 1)]]
        w = here[lo > 0 :][: hi - lo]
        before = np.zeros(hi - lo, bool)
        before[1:] = w[:-1]
        before[0] = lo > 0 and here[0]
        after = np.zeros(hi - lo, bool)
        after[:-1] = w[1:]
        after[-1] = hi < n and here[-1]
        a, z = np.searchsorted(bounds, [lo, hi])
        cut = bounds[a:z]
        before[cut[cut < hi] - lo] = False
        a, z = np.searchsorted(bounds, [lo + 1, hi + 1])
        after[bounds[a:z] - 1 - lo] = False
        starts.append(np.flatnonzero(w & ~before) + lo)
        ends.append(np.flatnonzero(w & ~after) + lo + 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, change: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of ascending, non-empty, non-overlapping spans; ``change`` maps bytes first (lower case)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi]
        part = (change[part] if change is not None else part).astype(np.uint64)
        part += np.uint64(1)
        part *= powers(BASE, hi - lo)
        edges = np.empty(2 * (j - i), np.int64)
        edges[::2], edges[1::2] = starts[i:j] - lo, ends[i:j] - lo
        total = np.add.reduceat(part, edges[:-1])[::2]
        total *= powers(INVERSE, hi - lo)[edges[::2]]
        out[i:j] = mix(total + (ends[i:j] - starts[i:j]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def counts(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending positions lie in each document."""
    return np.diff(np.searchsorted(positions, bounds))


def shingles(word: np.ndarray, per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their number in each document; a shorter, non-empty one gives one shingle."""
    n = len(word)
    size = np.maximum(per_doc - k + 1, (per_doc > 0).astype(per_doc.dtype))
    first = np.cumsum(per_doc) - per_doc
    total = int(size.sum())
    begin = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
    padded = np.concatenate([word, np.zeros(k, np.uint64)])
    end = np.repeat(first + per_doc, size)
    out = np.zeros(total, np.uint64)
    short = bool(n) and bool(((per_doc > 0) & (per_doc < k)).any())
    for j in range(k):
        at = begin + j
        x = padded[at]
        if short:
            x[at >= end] = 0
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += x
    return mix(out), size
