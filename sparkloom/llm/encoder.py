"""Byte-level BPE over whole documents, one library call per distinct piece of text.

A text may be cut between a non-blank character and a following ASCII blank: the pre-tokenizer of a byte-level BPE never
joins the two, so the pieces encode to the same ids alone as in their text. Pieces repeat heavily, so each worker keeps
their ids in an open-addressing table and asks the tokenizers library only for pieces it has not seen.
"""

from __future__ import annotations

import os

import numpy as np

from . import kernels as K

SLOTS = 1 << 22
MOST = SLOTS // 2
_encoders: dict[str, PieceEncoder] = {}

_STARTS = K.table(" \n\r\t")
#: A piece may end with a printable ASCII byte or with a byte above 127 that does not end a Unicode blank.
_ENDS = np.array([0x21 <= c <= 0x7E or c >= 0x80 for c in range(256)])
_LEADS = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])  # the three-byte blanks start with these
_C2 = np.isin(np.arange(256), [0x85, 0xA0])  # and the two-byte ones are C2 85 and C2 A0


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ascending starts of the pieces of a block; every non-empty document starts one."""
    found = []
    for lo in range(0, len(data), K.SLICE):
        hi = min(len(data), lo + K.SLICE)
        x = data[max(0, lo - 3) : hi]
        back = np.zeros(hi - lo + 3, np.uint8)
        back[len(back) - len(x) :] = x
        prev, prev2, prev3 = back[2:-1], back[1:-2], back[:-3]
        cut = _STARTS[back[3:]]
        cut &= _ENDS[prev]
        cut &= ~((prev2 == 0xC2) & _C2[prev])
        cut &= ~_LEADS[prev3]
        a, z = np.searchsorted(bounds, [lo, hi])
        cut[bounds[a:z] - lo] = True
        found.append(np.flatnonzero(cut) + lo)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.width = np.zeros(size, np.int64)  # bytes that an id stands for; byte-level tokens have a character a byte
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.code = np.zeros(SLOTS, np.int32)
        self.n, self.used = 0, 0
        self.first = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, self.dtype)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and the borders of its documents among them."""
        out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
        for code, doc in self._codes(data, bounds):
            length = self.length[code].astype(np.int64)
            ends = np.cumsum(length)
            at = np.arange(ends[-1] if len(ends) else 0)
            at += np.repeat(self.first[code] - (ends - length), length)
            out.append(self.ids[at])
            np.add.at(sizes, doc, length) if len(doc) < 64 else sizes.__iadd__(np.bincount(doc, length, len(sizes)).astype(np.int64))
        ids = np.concatenate(out) if out else np.zeros(0, self.dtype)
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces of a block and the number of ids of each."""
        starts, out = pieces(data, bounds), []
        for code, _ in self._codes(data, bounds, starts):
            out.append(self.length[code])
        return starts, np.concatenate(out) if out else np.zeros(0, np.int32)

    def _codes(self, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray | None = None):
        """(piece codes, their documents), slice by slice."""
        if starts is None:
            starts = pieces(data, bounds)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + K.SLICE, "right")))
            if self.n > MOST:
                self.clear()
            yield self._look(data, starts[i:j], ends[i:j]), np.searchsorted(bounds, starts[i:j], "right") - 1
            i = j

    def _look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key = K.span_hash(data, starts, ends)
        key[key == 0] = 1
        out, left = self._find(key)
        if len(left):
            new, where = np.unique(key[left], return_index=True)
            where = left[where]
            order, flat, length = self._encode(data, starts[where], ends[where])
            self._add(new[order], flat, length)
            out[left], missed = self._find(key[left])
            assert not len(missed)
        return out

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (key >> np.uint64(42)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        left, open_ = np.arange(len(key)), []
        while len(left):
            there = self.keys[slot]
            hit = there == key[left]
            out[left[hit]] = self.code[slot[hit]]
            go = ~hit & (there != 0)
            open_.append(left[~hit & ~go])
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return out, np.sort(np.concatenate(open_)) if open_ else left

    def _add(self, key: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        for name, more, have in (("first", len(key), self.n), ("length", len(key), self.n), ("ids", len(flat), self.used)):
            old = getattr(self, name)
            if have + more > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old), more), old.dtype)]))
        self.first[self.n : self.n + len(key)] = self.used + np.cumsum(length) - length
        self.length[self.n : self.n + len(key)] = length
        self.ids[self.used : self.used + len(flat)] = flat
        code = np.arange(self.n, self.n + len(key), dtype=np.int32)
        self.n, self.used = self.n + len(key), self.used + len(flat)
        slot = (key >> np.uint64(42)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]] = key[left[put]]
            self.code[slot[put]] = code[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (SLOTS - 1)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the given distinct pieces, their ids in that order, and how many each has.

        Pieces that start with a blank and end with an ASCII character can stand side by side; they go to the library
        as long strings, and the byte widths of the ids tell where each piece ends.
        """
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        joined = _STARTS[data[starts]] & (last >= 0x21) & (last <= 0x7E) & (before < 0x80)
        together = np.flatnonzero(joined)
        order, ids, length, alone = [], [], [], [np.flatnonzero(~joined)]
        size = ends[together] - starts[together]
        group = np.cumsum(size) >> 14
        for part in np.split(together, np.flatnonzero(np.diff(group)) + 1) if len(together) else []:
            text = b"".join([data[a:z].tobytes() for a, z in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
            got = np.array(self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.dtype)
            stop = np.cumsum(self.width[got])
            border = np.cumsum(ends[part] - starts[part])
            at = np.searchsorted(stop, border)
            if len(stop) == 0 or stop[-1] != border[-1] or (stop[at] != border).any():
                alone.append(part)  # not a byte-level vocabulary after all: one by one
                continue
            order.append(part)
            ids.append(got)
            length.append(np.diff(at, prepend=-1))
        rest = np.concatenate(alone)
        if len(rest):
            texts = [data[a:z].tobytes().decode() for a, z in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            order.append(rest)
            ids.append(np.array([i for x in got for i in x], self.dtype))
            length.append(np.array([len(x) for x in got]))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(length).astype(np.int32)
