"""Operator 5: removal of every byte that a repeated string of ``size`` bytes covers, by two-stage suffix sorting.

Suffixes of a whole corpus are not sorted in one place. Every string of ``size`` bytes is dealt by content: it goes
with its anchor, the leftmost of its ``GRAM``-byte substrings with the smallest hash. Equal strings have equal anchors
at the same offset, so a string can only repeat among strings whose anchors have the same hash.

1. Documents yield the distinct hashes of their anchors, about one in ``size / 2`` bytes. Hashes that one anchor in the
   corpus has are dropped: almost all unique text ends here.
2. The strings of the anchors left are cut into pieces, runs whose anchor offsets lie within a step of ``WIDTH``. All
   strings of a piece share its core of ``size - WIDTH + 1`` bytes, so a piece is dealt by the hash of its core, and only
   pieces whose core occurs again go on. Equal pieces collapse (by 64-bit hash within a core): all their strings repeat.
3. One of each kind of piece goes to its core. Different ones with one core are suffix-sorted (``suffixes.Block``), and
   strings whose neighbour in that order has a common prefix of ``size`` bytes are repeated; bytes decide.
4. A core with more than ``MOST`` kinds of pieces (a passage in very many contexts) is split: its pieces are cut again at
   a quarter of the width, so their cores are longer, and steps 2 and 3 repeat with them. At width one a piece is a string.
5. Runs of repeated strings make the removed spans. Copies of a whole text are known by digest beforehand; one of them
   stands for all.

A text yields each kind of piece once, with its number, so runs and periods of any length make few rows. Texts are read in
slices. Defined cases: null and empty texts have no bytes; texts shorter than ``size`` lose nothing; a text that occurs
twice and is long enough loses everything; runs of one byte repeat within themselves; an empty table gives no rows; rows
that repeat an id are documents of their own; a null id is an id; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .suffixes import Block

GRAM = 64
WIDTH = 128
MOST = 2048
TEXT = 1 << 20  # bytes of segments in one suffix sort, about
SECOND = np.uint64(0xD1342543DE82EF95)
SECOND_INVERSE = np.uint64(pow(int(SECOND), -1, 1 << 64))
POSITION = 21  # bits of a position within a slice


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(int(K.BASE), step, 1 << 64)) + h[step:]
        step *= 2
    return K.mix(h)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(v) - w + 1
    whole = -(-len(v) // w) * w
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice begin, slice, first string, number of strings, anchor, anchor hash) slice by slice; positions in the slice.

    Each entry is a run of strings with one anchor.
    """
    last = bounds[1:] - size  # of each document's strings
    step = K.SLICE // 2
    for lo in range(0, len(data) - size + 1, step):
        part = data[lo : lo + step + size - 1]
        h = _gram_hashes(part)
        at = np.arange(len(h), dtype=np.uint64)
        low = _sliding_min((h >> np.uint64(POSITION) << np.uint64(POSITION)) | at, size - GRAM + 1) & np.uint64((1 << POSITION) - 1)
        low = low.astype(np.int64)
        start = np.arange(len(low)) + lo
        doc = np.searchsorted(bounds, start, "right") - 1
        owner = np.where(start <= last[doc], low, -1)
        change = np.ones(len(owner), bool)
        change[1:] = owner[1:] != owner[:-1]
        # a document's first string never shares its anchor with the document before
        first = np.flatnonzero(change)
        many = np.diff(np.append(first, len(owner)))
        good = owner[first] >= 0
        first = first[good]
        yield lo, part, first, many[good], owner[first], h[owner[first]]


def _hasher(part: np.ndarray, base: np.uint64, inverse: np.uint64):
    """Hashes of substrings (from, to) of a slice."""
    x = part.astype(np.uint64) + np.uint64(1)
    x *= K.powers(base, len(x))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    shift = K.powers(inverse, len(x))
    return lambda a, z: K.mix((prefix[z] - prefix[a]) * shift[a])


def cut(part: np.ndarray, first: np.ndarray, many: np.ndarray, offset: np.ndarray, dealt: np.ndarray, size: int, width: int) -> tuple[np.ndarray, ...]:
    """Cut runs of strings into pieces: (run, first string, number of strings, anchor offset, core hash, content hash).

    ``offset`` is how far a run's anchor lies behind its first string, ``dealt`` the hash that the run was dealt by.
    """
    least = offset - many + 1
    steps = offset // width - least // width + 1
    run = np.repeat(np.arange(len(first)), steps)
    j = offset[run] // width - (np.arange(len(run)) - np.repeat(np.cumsum(steps) - steps, steps))
    top = np.minimum(offset[run], j * width + width - 1)
    low = np.maximum(least[run], j * width)
    start = first[run] + offset[run] - top
    n = top - low + 1
    core = first[run] + offset[run] - j * width
    one = _hasher(part, K.BASE, K.INVERSE)
    two = _hasher(part, SECOND, SECOND_INVERSE)
    key = K.mix(one(core, core + size - width + 1) + K.mix(dealt[run] + j.astype(np.uint64) * SECOND))
    kind = K.mix(two(start, start + n - 1 + size) + K.mix(key + n.astype(np.uint64) * K.BASE))
    return run, start, n, top, key, kind


def _anchor_rows(texts: DataFrame, size: int) -> DataFrame:
    """(digest, h, first, last): the anchor hashes of each text, and the first and last anchor that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, bounds, _ in K.blocks(b.column(1)):
                for lo, _, _, _, at, h in anchors(data, bounds, size):
                    doc = np.searchsorted(bounds, at + lo, "right") - 1
                    at = at + lo - bounds[doc]
                    order = np.lexsort((at, h, doc))
                    h, doc, at = h[order], doc[order], at[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True)[: len(h)])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + doc[first])), pa.array(h[first].view(np.int64)), pa.array(at[first]), pa.array(at[last])], names=["digest", "h", "first", "last"])

    return texts.mapInArrow(run, "digest binary, h long, first long, last long")


PIECES = "digest binary, key long, kind long, c long, at long, many int, off int, alone boolean"
_NAMES = ["digest", "key", "kind", "c", "at", "many", "off", "alone"]


def _pieces(texts: DataFrame, size: int) -> DataFrame:
    """The pieces (``PIECES``) of the anchors ``hs`` of (digest, text, hs), each kind once a slice with its number ``c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                data = np.frombuffer(b.column(1)[i].as_buffer(), np.uint8)
                wanted = np.sort(np.asarray(b.column(2)[i].values).view(np.uint64))
                for lo, part, first, many, anchor, h in anchors(data, np.array([0, len(data)]), size):
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    good = wanted[at] == h
                    first, many, anchor, h = first[good], many[good], anchor[good], h[good]
                    if not len(first):
                        continue
                    _, start, n, off, key, kind = cut(part, first, many, anchor - first, h, size, WIDTH)
                    _, one, c = np.unique(kind, return_index=True, return_counts=True)
                    for x in range(0, len(one), 4096):
                        o = one[x : x + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([b.column(0)[i].as_py()] * len(o), pa.binary()), pa.array(key[o].view(np.int64)), pa.array(kind[o].view(np.int64)), pa.array(c[x : x + 4096].astype(np.int64)), pa.array(start[o] + lo), pa.array(n[o].astype(np.int32)), pa.array(off[o].astype(np.int32)), pa.array(np.ones(len(o), bool))],
                            names=_NAMES,
                        )

    return texts.mapInArrow(run, PIECES)


def _refined(segments: DataFrame, size: int, width: int) -> DataFrame:
    """The pieces of a smaller width (``PIECES``) of (key, digest, at, many, off, alone, segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(1, np.int64)
        for b in batches:
            for i, (key, digest, at, many, off, alone) in enumerate(zip(*(b.column(j).to_pylist() for j in range(6)), strict=True)):
                part = np.frombuffer(b.column(6)[i].as_buffer(), np.uint8)
                _, start, n, top, k, kind = cut(part, zero, zero + many, zero + off, np.array([key], np.int64).view(np.uint64), size, width)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(k), pa.binary()), pa.array(k.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(np.ones(len(k), np.int64)), pa.array(start + at), pa.array(n.astype(np.int32)), pa.array(top.astype(np.int32)), pa.array([alone] * len(k))], names=_NAMES)

    return segments.mapInArrow(run, PIECES)


def _segments(members: DataFrame, rich: DataFrame, size: int) -> DataFrame:
    """(key, digest, at, many, off, alone, segment): the bytes of members, one shuffle of them by text."""
    lists = members.groupBy("digest").agg(F.collect_list(F.struct("key", "at", "many", "off", "alone")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                raw = b.column(1)[i].as_buffer()
                key, at, many, off, alone = b.column(2)[i].values.flatten()
                for lo in range(0, len(key), 1000):
                    s = slice(lo, lo + 1000)
                    spans = zip(at[s].to_pylist(), many[s].to_pylist(), strict=True)
                    parts = pa.array([raw[a : a + m - 1 + size].to_pybytes() for a, m in spans], pa.binary())
                    digest = b.column(0).take(pa.array(np.full(len(parts), i)))
                    yield pa.RecordBatch.from_arrays([key[s], digest, at[s], many[s], off[s], alone[s], parts], names=["key", "digest", "at", "many", "off", "alone", "segment"])

    rows = rich.select("digest", "text").join(lists, "digest").select("digest", "text", "m")
    return rows.mapInArrow(run, "key long, digest binary, at long, many int, off int, alone boolean, segment binary")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_repeats(segments: DataFrame, size: int) -> DataFrame:
    """(digest, start, stop): repeated strings of the segments that are ``alone``; segments arrive in runs of one key."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        many = [m for _, _, m, _, _ in held]
        block = Block([s for *_, s in held], many, size)
        flags = block.repeated()
        digest, start, stop = [], [], []
        for (d, at, m, alone, _), begin in zip(held, block.begin.tolist(), strict=True):
            if alone and (mask := flags[begin : begin + m]).any():
                a, z = _runs(mask)
                digest += [d] * len(a)
                start.append(a + at)
                stop.append(z - 1 + at + size)
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(np.concatenate(start)), pa.array(np.concatenate(stop))], names=["digest", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, size_ = None, 0
        for b in batches:
            for key, digest, at, many, _, alone, segment in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last and size_ > TEXT:
                    yield from flush(held)
                    held, size_ = [], 0
                last = key
                held.append((digest, at, many, alone, segment))
                size_ += len(segment)
        yield from flush(held)

    return segments.mapInArrow(run, "digest binary, start long, stop long")


def _repeats(pieces: DataFrame, rich: DataFrame, size: int, width: int, used: list[str]) -> list[DataFrame]:
    """Tables (digest, kind, start, stop) of what repeats: kinds of pieces of the first width, and explicit spans."""
    out: list[DataFrame] = []
    none = lambda t: F.lit(None).cast(t)
    while True:
        kinds = pieces.groupBy("key", "kind").agg(F.sum("c").alias("n"), F.min(F.struct("digest", "at", "many", "off", "alone")).alias("one"))
        kinds = common.staged(kinds, "kinds", used)
        keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1) & F.col("one.alone")).alias("open"))
        keys = common.staged(keys.where("kinds > 1 AND open").select("key", (F.col("kinds") > MOST).alias("hot")), "keys", used)
        again = pieces.where("alone").join(kinds.where("n > 1").select("key", "kind"), ["key", "kind"], "left_semi")
        if width == WIDTH:
            out.append(again.select("digest", "kind", none("long").alias("start"), none("long").alias("stop")))
        else:
            out.append(again.select("digest", none("long").alias("kind"), F.col("at").alias("start"), (F.col("at") + F.col("many") - 1 + size).alias("stop")))
        members = kinds.join(keys, "key").select("key", "hot", "one.digest", "one.at", "one.many", "one.off", (F.col("one.alone") & (F.col("n") == 1)).alias("alone"))
        calm = _segments(members.where("NOT hot"), rich, size).repartition("key").sortWithinPartitions("key")
        out.append(_sorted_repeats(calm, size).select("digest", none("long").alias("kind"), "start", "stop"))
        if width == 1 or not keys.where("hot").limit(1).count():
            return out
        width //= 4
        pieces = common.staged(_refined(_segments(members.where("hot"), rich, size), size, max(width, 1)), "pieces", used)


def _spans(data: np.ndarray, kinds: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Starts and stops of the pieces of a text whose kinds are given, in ascending order."""
    start, stop = [], []
    for lo, part, first, many, anchor, h in anchors(data, np.array([0, len(data)]), size) if len(kinds) else ():
        if len(first):
            _, at, n, _, _, kind = cut(part, first, many, anchor - first, h, size, WIDTH)
            good = kinds[np.minimum(np.searchsorted(kinds, kind), len(kinds) - 1)] == kind
            start.append(at[good] + lo)
            stop.append(at[good] + lo + n[good] - 1 + size)
    return start, stop


def _cut(texts: DataFrame, size: int, with_bytes: bool) -> DataFrame:
    """What is left of (digest, text, kinds, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(len(b)):
                raw = memoryview(b.column(1)[i].as_buffer())
                kinds = np.sort(np.asarray(b.column(2)[i].values).view(np.uint64))
                start, stop = _spans(np.frombuffer(raw, np.uint8), kinds, size)
                more = b.column(3)[i].values.flatten()
                start, stop = (np.concatenate([*x, np.asarray(y)]) for x, y in zip((start, stop), more, strict=True))
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > stop[:-1]
                a, z = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                kept = b"".join(raw[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append((int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, with_bytes: bool = False) -> DataFrame:
    """(doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row; kept is what stays, as bytes."""
    if size < 2 * GRAM:
        raise ValueError(f"size must be {2 * GRAM} bytes or more")
    spark = common.session(docs.sparkSession)
    used: list[str] = []
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.md5("text"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    texts = base.where(F.col("n_bytes") >= size).select("digest", "text")
    found = _anchor_rows(texts, size).select("digest", "h", F.xxhash64("digest", "first").alias("x"), F.xxhash64("digest", "last").alias("y"))
    found = common.staged(found, "anchors", used)
    # copies of a text have the same places, so only a hash with two different places is more than one anchor
    often = found.groupBy("h").agg(F.min(F.least("x", "y")).alias("x"), F.max(F.greatest("x", "y")).alias("y")).where("x <> y")
    often = common.staged(often.select("h"), "often", used)
    lists = found.join(often, "h", "left_semi").groupBy("digest").agg(F.collect_set("h").alias("hs"))
    rich = common.staged(texts.dropDuplicates(["digest"]).join(lists, "digest").select("digest", "text", "hs"), "texts", used)
    pieces = common.staged(_pieces(rich, size), "pieces", used)

    found, *more = _repeats(pieces, rich, size, WIDTH, used)
    for x in more:
        found = found.unionByName(x)
    spans = found.groupBy("digest").agg(F.collect_list("kind").alias("kinds"), F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans"))
    cut_ = common.staged(_cut(rich.select("digest", "text").join(spans, "digest").select("digest", "text", "kinds", "spans"), size, with_bytes), "cut")

    copies = texts.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest", F.lit(True).alias("copied"))
    rows = base.select("doc_id", "digest", "n_bytes", F.sha2("text", 256).alias("sha"), *([F.col("text").cast("binary").alias("raw")] if with_bytes else []))
    out = rows.join(cut_, "digest", "left").join(copies, "digest", "left")
    pick = lambda all_, some, none: F.when(F.col("copied"), all_).otherwise(F.coalesce(some, none))
    out = out.withColumn("sha", pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("sha")))
    kept = [pick(F.lit(b""), "kept", F.col("raw")).alias("kept")] if with_bytes else []
    out = out.select("doc_id", "digest", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)).alias("n_removed"), pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *kept)
    common.drop(spark, *used)
    return out
