"""Two-stage suffix sorting of a block of strings, to a bounded depth, with adjacent common prefixes.

A suffix is of type B if it is smaller than its successor (the suffix one further on), else of type A. Stage one sorts
the B suffixes directly. Stage two induces the A suffixes: buckets of equal first bytes are scanned in ascending order,
and each scanned suffix puts its predecessor, if that is of type A, at the next free place of its bucket. A bucket's A
suffixes all come before its B suffixes, so one scan from left to right sorts everything. NumPy scans a whole bucket at
a time; runs of one byte take a pass per byte of the run.

Only suffixes that matter are sorted: those that start in a wanted range, and the few A suffixes after a range's end up
to the next B suffix, on which its last members depend. Orders beyond ``depth`` bytes are left open.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K


class Block:
    """Strings laid end to end with a zero byte after each; ``wanted`` marks the suffix starts of interest.

    Strings must not hold the bytes 0 (after the shift by one: 255), which no UTF-8 text does.
    """

    def __init__(self, strings: list[bytes], wanted: list[int], depth: int):
        size = np.array([len(s) for s in strings], np.int64) + 1
        self.x = np.frombuffer(b"\xff".join(strings) + b"\xff" * (depth + 9), np.uint8) + np.uint8(1)
        self.depth = depth
        self.begin = np.cumsum(size) - size
        self.n = int(size.sum())
        many = np.array(wanted, np.int64)
        self.wanted = np.zeros(self.n, bool)
        self.wanted[_ranges(self.begin, many)] = True
        part = self.x.astype(np.uint64) * K.powers(K.BASE, len(self.x))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        self.power = K.powers(K.BASE, len(self.x) + 1)
        self.last = self.begin + many - 1

    def same(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        """Whether the substrings of a length that start at a and at b have equal hashes."""
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        p = self.prefix
        return (p[lo + length] - p[lo]) * self.power[hi - lo] == p[hi + length] - p[hi]

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes, up to the depth."""
        out = np.zeros(len(a), np.int64)
        step = 1 << (self.depth.bit_length() - 1)
        while step:
            at = np.flatnonzero(out + step <= self.depth)
            good = self.same(a[at] + out[at], b[at] + out[at], step)
            out[at[good]] += step
            step >>= 1
        return out

    def sort(self) -> np.ndarray:
        """Starts of the wanted suffixes in lexicographic order."""
        x, n = self.x, self.n
        step = np.sign(x[1 : n + 1].astype(np.int16) - x[:n])
        at = np.where(step != 0, np.arange(n), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        is_b = np.append(step, 1)[at] > 0
        next_b = np.minimum.accumulate(np.where(is_b, np.arange(n), n - 1)[::-1])[::-1]
        needed = self.wanted.copy()
        needed[_ranges(self.last, next_b[self.last] - self.last + 1)] = True
        # the last terminator has no successor; nothing needed is beyond it
        order = self._direct(np.flatnonzero(needed & is_b))
        return self._induced(order, needed & ~is_b)

    def _key(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each position as one number in text order."""
        return np.ndarray((len(self.x) - 7,), ">u8", self.x, 0, (1,))[at].astype(np.uint64)

    def _direct(self, at: np.ndarray) -> np.ndarray:
        """Sort suffixes by comparing them. Groups that are still equal skip their common prefix and go on there."""
        key = self._key(at)
        order = np.argsort(key, kind="stable")
        out, key = at[order], key[order]
        slot = np.arange(len(out))
        new = np.ones(len(out), bool)
        new[1:] = key[1:] != key[:-1]
        while True:
            alone = new & np.append(new[1:], True)
            slot, new = slot[~alone], new[~alone]
            if not len(slot):
                return out
            here = out[slot]
            pair = np.flatnonzero(~new)
            lcp = np.full(len(slot), self.depth, np.int64)
            lcp[pair] = self.common_prefix(here[pair - 1], here[pair])
            start = np.flatnonzero(new)
            deep = np.minimum.reduceat(lcp, start)
            group = np.cumsum(new) - 1
            go = (deep < self.depth)[group]
            slot, here, new, group = slot[go], here[go], new[go], group[go]
            if not len(slot):
                return out
            key = self._key(here + deep[group])
            order = np.argsort(key, kind="stable")
            order = order[np.argsort(group[order], kind="stable")]
            here, key = here[order], key[order]
            out[slot] = here
            new = new.copy()
            new[1:] |= key[1:] != key[:-1]

    def _induced(self, direct: np.ndarray, type_a: np.ndarray) -> np.ndarray:
        """All needed suffixes in order, wanted ones returned, from the sorted B suffixes."""
        x = self.x
        border = np.searchsorted(x[direct], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []

        def scan(found: np.ndarray, c: int) -> np.ndarray:
            """Give the predecessors of scanned suffixes to their buckets; those of bucket c itself are returned."""
            out.append(found)
            before = found[found > 0] - 1
            before = before[type_a[before]]
            first = x[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.diff(first)) + 1
            own = before[:0]
            for part in np.split(before, cut) if len(before) else []:
                if x[part[0]] == c:
                    own = part
                else:
                    waiting[x[part[0]]].append(part)
            return own

        for c in range(256):
            if waiting[c]:
                found = np.concatenate(waiting[c])
                waiting[c] = []
                while len(found):
                    found = scan(found, c)
            if border[c] < border[c + 1]:
                scan(direct[border[c] : border[c + 1]], c)
        order = np.concatenate(out) if out else direct
        return order[self.wanted[order]]

    def repeated(self) -> np.ndarray:
        """For every position, whether it starts a wanted string of ``depth`` bytes that another wanted one equals."""
        order = self.sort()
        out = np.zeros(self.n, bool)
        equal = np.flatnonzero(self.same(order[:-1], order[1:], self.depth))
        if not len(equal):
            return out
        # hashes nominate, bytes decide: neighbours are compared along diagonals, where one step adds one byte
        a, b = np.concatenate([order[equal], order[equal + 1]]), np.concatenate([order[equal + 1], order[equal]])
        by = np.lexsort((a, b - a))
        a, b = a[by], b[by]
        run = np.ones(len(a), bool)
        run[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
        start = np.flatnonzero(run)
        length = np.diff(np.append(start, len(a))) + self.depth - 1
        differ = np.concatenate([[0], np.cumsum(self.x[_ranges(a[start], length)] != self.x[_ranges(b[start], length)])])
        at = np.repeat((np.cumsum(length) - length) - start, np.diff(np.append(start, len(a)))) + np.arange(len(a))
        out[a[differ[at + self.depth] == differ[at]]] = True
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, one after the other."""
    total = np.cumsum(length)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(start - (total - length), length) + np.arange(total[-1])
