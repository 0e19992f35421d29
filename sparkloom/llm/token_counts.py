"""Operator 3: token counts that follow edits, from a segment tree of pre-token pieces per document.

A document's leaves are runs of whole pieces (``encoder.pieces``) of about ``LEAF`` bytes; pieces encode to the same ids
alone as in their text, so a leaf's count is the sum over its pieces, and the tree over the leaves holds the count of any
stretch. An edit (a byte range and its replacement) touches some leaves. Their new text is cut out together with
its boundary context: it grows by a leaf on either side as long as the cut there does not hold any more in the
edited text. Only that region is encoded again. Its bytes and counts go to the first of its leaves, the others become empty,
and the sums on their paths to the root are updated; all other leaves keep their counts. A leaf that has grown to
``SPLIT`` times its size is split again at piece borders, and the tree is rebuilt from leaf counts without encoding.

Trees are rows of two arrays (``TREES``): ``build_trees`` makes them, and they are stored with their texts. ``apply_edits`` reads
stored trees with new edits and encodes the touched regions alone; its rows are stored trees again, for the next edits.
``encoded_bytes`` says how much of a text was encoded. Defined cases: a null text is an empty
one and has a tree of one empty leaf; null or no edits change nothing; edits must be sorted, lie within the text and not
overlap, else the row fails with the id named; an edit that splits a UTF-8 character fails likewise; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .encoder import PieceEncoder, encoder, pieces

LEAF = 512
SPLIT = 8

EDITS = "array<struct<start:int,stop:int,text:string>>"


class Tree:
    """Sums over leaves, root at 1; leaf i is at ``width + i``. ``ends`` are the leaves' end offsets in bytes."""

    def __init__(self, ends: np.ndarray, counts: np.ndarray):
        self.ends = ends
        self.width = 1 << max(0, int(len(ends) - 1).bit_length())
        self.sums = np.zeros(2 * self.width, np.int64)
        self.sums[self.width : self.width + len(counts)] = counts
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    @property
    def counts(self) -> np.ndarray:
        return self.sums[self.width : self.width + len(self.ends)]

    def set(self, leaf: int, count: int) -> None:
        """Change a leaf and the sums on its path to the root."""
        at = self.width + leaf
        change = count - int(self.sums[at])
        while at and change:
            self.sums[at] += change
            at //= 2

    def before(self, leaf: int) -> int:
        """Tokens in all leaves before one."""
        at, out = self.width + leaf, 0
        while at > 1:
            if at & 1:
                out += int(self.sums[at - 1])
            at //= 2
        return out


def leaves(starts: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Group a document's pieces into leaves: (end offsets, counts)."""
    if not len(starts):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    first = np.flatnonzero(np.diff(starts // LEAF, prepend=-1))
    return np.append(starts[first[1:]], size), np.add.reduceat(length.astype(np.int64), first)


def build(enc: PieceEncoder, data: np.ndarray, bounds: np.ndarray) -> list[Tree]:
    """The trees of a block of documents."""
    starts, length = enc.lengths(data, bounds)
    at = np.searchsorted(starts, bounds)
    return [Tree(*leaves(starts[a:z] - b, length[a:z], e - b)) for a, z, b, e in zip(at[:-1].tolist(), at[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _holds(text: bytes, at: int) -> bool:
    """Whether a piece starts at this offset of a text, judged by the bytes around it."""
    lo = max(0, at - 3)
    x = np.frombuffer(text[lo : at + 1], np.uint8)
    return at in (pieces(x, np.array([0, len(x)])) + lo).tolist()


class Edited:
    """One document under its edits: what to encode again, and where the result goes."""

    def __init__(self, text: bytes, tree: Tree, edits: list[tuple[int, int, bytes]], name: object):
        at, parts, shift, places = 0, [], 0, []
        for start, stop, new in edits:
            if not at <= start <= stop <= len(text):
                raise ValueError(f"document {name}: edits must be sorted, lie within the text and not overlap")
            if any(x < len(text) and text[x] & 0xC0 == 0x80 for x in (start, stop)):
                raise ValueError(f"document {name}: an edit splits a character")
            parts += [text[at:start], new]
            places.append((start, stop, shift, shift + len(new) - (stop - start)))
            shift = places[-1][3]
            at = stop
        self.text = b"".join([*parts, text[at:]])
        self.tree = tree
        self.regions: list[list[int]] = []  # first leaf, last leaf, new start, new stop
        ends = tree.ends
        begins = np.concatenate([[0], ends[:-1]])
        # shifts tell where an old offset lies in the new text
        starts = np.array([p[0] for p in places])
        after = np.array([0, *(p[3] for p in places)])
        moved = lambda x: int(x + after[np.searchsorted(starts, x, "left")])
        for start, stop, _, _ in places:
            a = min(int(np.searchsorted(ends, start, "right")), len(ends) - 1)
            z = max(a, min(int(np.searchsorted(ends, stop, "left")), len(ends) - 1))
            while a > 0 and (start <= begins[a] or not _holds(self.text, moved(begins[a]))):
                a -= 1
                start = int(begins[a]) + 1
            while z < len(ends) - 1 and (stop >= ends[z] or not _holds(self.text, moved(ends[z]))):
                z += 1
                stop = int(ends[z]) - 1
            if self.regions and a <= self.regions[-1][1]:
                a, z = self.regions[-1][0], max(z, self.regions[-1][1])
                self.regions.pop()
            self.regions.append([a, z, 0, 0])
        for r in self.regions:
            r[2] = moved(begins[r[0]]) if r[0] else 0
            r[3] = moved(ends[r[1]]) if r[1] < len(ends) - 1 else len(self.text)

    def apply(self, encoded: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """The new tree; ``encoded`` has the pieces of each region: (starts within it, counts)."""
        ends = self.tree.ends.copy()
        shift, last, grown = 0, 0, False
        for (a, z, lo, hi), (_, length) in zip(self.regions, encoded, strict=True):
            ends[last:a] += shift
            shift = hi - int(self.tree.ends[z])
            ends[a : z + 1] = hi
            last = z + 1
            self.tree.set(a, int(length.sum()))
            for leaf in range(a + 1, z + 1):
                self.tree.set(leaf, 0)
            grown |= hi - lo > SPLIT * LEAF
        ends[last:] += shift
        self.tree.ends = ends
        return self._split(encoded) if grown else self.tree

    def _split(self, encoded: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        ends, counts, last = [], [], 0
        for (a, z, lo, hi), (starts, length) in zip(self.regions, encoded, strict=True):
            e, c = leaves(starts, length, hi - lo)
            ends += [self.tree.ends[last:a], e + lo]
            counts += [self.tree.counts[last:a], c]
            last = z + 1
        return Tree(np.concatenate([*ends, self.tree.ends[last:]]), np.concatenate([*counts, self.tree.counts[last:]]))


TREES = "doc_id long, text string, leaf_ends array<int>, leaf_tokens array<int>"
RESULT = "doc_id long, n_bytes long, n_edits long, tokens_before long, tokens_after long, n_leaves long, encoded_bytes long, text string, leaf_ends array<int>, leaf_tokens array<int>"
_INTS = pa.list_(pa.int32())


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees (``TREES``) of all documents: their texts are encoded whole, once."""
    common.session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for first, data, bounds, _ in K.blocks(b.column(1)):
                trees, rows = build(enc, data, bounds), slice(first, first + len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], b.column(1)[rows], pa.array([t.ends for t in trees], _INTS), pa.array([t.counts for t in trees], _INTS)], names=["doc_id", "text", "leaf_ends", "leaf_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, TREES)


def _edit(enc: PieceEncoder, ids: list, texts: list[bytes], trees: list[Tree], edits: list[list[tuple[int, int, bytes]]]) -> pa.RecordBatch:
    """Rows ``RESULT`` of documents under their edits; regions of all of them are encoded together."""
    before = [t.total for t in trees]
    changed = {i: Edited(texts[i], trees[i], e, ids[i]) for i, e in enumerate(edits) if e}
    encoded = _encode(enc, [d.text[r[2] : r[3]] for d in changed.values() for r in d.regions])
    at = 0
    for i, d in changed.items():
        trees[i] = d.apply(encoded[at : at + len(d.regions)])
        texts[i] = d.text
        at += len(d.regions)
    again = [sum(r[3] - r[2] for r in changed[i].regions) if i in changed else 0 for i in range(len(ids))]
    columns = [ids, [len(t) for t in texts], [len(e) for e in edits], before, [t.total for t in trees], [len(t.ends) for t in trees], again]
    arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array([t.decode() for t in texts]), pa.array([t.ends for t in trees], _INTS), pa.array([t.counts for t in trees], _INTS)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in RESULT.split(", ")])


def _edit_rows(trees: DataFrame, tokenizer: str, edits_of) -> DataFrame:
    """Apply what ``edits_of`` makes of a batch, a list of edits (start, stop, bytes) for each row, to (``TREES``, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            edits = edits_of(b)
            # a bounded part of a batch at a time: texts and their edited copies are held together
            for a, data, bounds, _ in K.blocks(b.column(1)):
                z = a + len(bounds) - 1
                texts = [data[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                held = [Tree(np.asarray(e.values).astype(np.int64), np.asarray(c.values)) for e, c in zip(b.column(2)[a:z], b.column(3)[a:z], strict=True)]
                yield _edit(enc, b.column(0)[a:z].to_pylist(), texts, held, edits[a:z])

    return trees.mapInArrow(run, RESULT)


def apply_edits(trees: DataFrame, tokenizer: str, edits: F.Column) -> DataFrame:
    """Stored trees (``TREES``) under their ``edits`` (a column of type ``EDITS``): columns ``RESULT``."""
    common.session(trees.sparkSession)

    def given(b: pa.RecordBatch) -> list[list[tuple[int, int, bytes]]]:
        return [[(e["start"], e["stop"], (e["text"] or "").encode()) for e in x or ()] for x in b.column(4).to_pylist()]

    rows = trees.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "leaf_ends", "leaf_tokens", edits.cast(EDITS).alias("edits"))
    return _edit_rows(rows, tokenizer, given)


def count_edits(docs: DataFrame, edits: F.Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trees of all documents before and after their ``edits`` (a column of type ``EDITS``): columns ``RESULT``.

    Documents and edits go through in one pass, for edits that come with their texts; later ones go to ``apply_edits``.
    """
    common.session(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), edits.cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for first, data, bounds, _ in K.blocks(b.column(1)):
                n = len(bounds) - 1
                lists = [[(e["start"], e["stop"], (e["text"] or "").encode()) for e in x or ()] for x in b.column(2)[first : first + n].to_pylist()]
                texts = [data[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield _edit(enc, b.column(0)[first : first + n].to_pylist(), texts, build(enc, data, bounds), lists)

    return rows.mapInArrow(run, RESULT)


def _encode(enc: PieceEncoder, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    if not parts:
        return []
    data = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    starts, length = enc.lengths(data, bounds)
    at = np.searchsorted(starts, bounds)
    return [(starts[a:z] - b, length[a:z]) for a, z, b in zip(at[:-1].tolist(), at[1:].tolist(), bounds[:-1].tolist(), strict=True)]


MASKS = ((r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+", "<EMAIL>"), (r"[0-9]{9,}", "<NUMBER>"))


def mask_edits(text: str | None) -> list[tuple[int, int, str]]:
    """Edits that mask e-mail addresses and long numbers, as byte ranges; the earlier match wins where two overlap."""
    text = text or ""
    if "@" not in text and not re.search(r"[0-9]{9}", text):
        return []
    found = sorted((m.start(), -m.end(), new) for pattern, new in MASKS for m in re.finditer(pattern, text))
    out, at, seen, size = [], 0, 0, 0
    for start, stop, new in found:
        if start >= at:
            size += len(text[seen:start].encode())
            width = len(text[start:-stop].encode())
            out.append((size, size + width, new))
            size, seen, at = size + width, -stop, -stop
    return out


def masked_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts before and after personal data is masked: trees are built, then edited where something is masked."""

    def masks(b: pa.RecordBatch) -> list[list[tuple[int, int, bytes]]]:
        return [[(s, e, t.encode()) for s, e, t in mask_edits(x.as_py())] for x in b.column(1)]

    return _edit_rows(build_trees(docs, tokenizer, id_col, text_col), tokenizer, masks)
