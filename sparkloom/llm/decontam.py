"""Operator 2: benchmark decontamination as a prefix-filtered set join with exact verification.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``window`` consecutive words of
an item, or the whole of a shorter, non-empty item. A window is a set of word shingles (five words, fewer in windows that
are shorter); a text contains it only if it has every one of them, so the necessary prefix of a window is one shingle.

1. Rarity: documents are scanned for benchmark shingles, and their document frequencies order them.
2. Each window is indexed by its rarest shingle and that shingle's offset. A window with a shingle that no document has
   is out already.
3. Documents are scanned for indexed shingles. A hit carries its position and the words around it, enough for any
   window that the shingle can lie in; hits and windows are joined on the shingle. Length and position must fit, and
   then the words themselves must be equal: hashes only ever nominate.

Bit filters drop shingles of no interest in the scans. They are built on the executors, a segment in a task, and have a
fixed size (16 MB at most): with very many benchmark shingles they let more through, which the joins, shuffled either way, drop.
An item of fewer words than a shingle is its own shingle; a document tells its places once, not a row and its context for each.

Defined cases: null and empty texts have no words, no hits, and are not contaminated; empty and null items have no
windows; items that repeat an id count once; a null item id counts as the empty string; documents that repeat an id or a
text are judged one by one; an empty benchmark contaminates nothing; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from . import kernels as K

SHINGLE = 5
MOST_BITS, SEGMENT = 27, 19  # powers of two: bits of a filter, bits of a segment of it
RESULT = ["doc_id", "digest", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


class BitFilter:
    """A Bloom filter of two bits a value, about 32 bits of room for each, as an array of bytes; 16 MB at most."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def over(cls, df: DataFrame, column: str, n: int) -> BitFilter:
        """The filter of a column with about n values. Each segment is filled by one task; only segments reach the driver."""
        bits = min(MOST_BITS, max(10, (max(1, n) * 32 - 1).bit_length()))
        segment = min(bits, SEGMENT)
        low, high = F.col(column).bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(column, 64 - bits)
        slots = df.select(F.explode(F.array(low, high)).alias("slot")).distinct()
        slots = slots.select(F.shiftright("slot", segment).alias("part"), F.col("slot").bitwiseAND((1 << segment) - 1).alias("bit"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for b in batches:
                part, bit = np.asarray(b.column(0)), np.asarray(b.column(1))
                for p in np.unique(part).tolist():
                    at = bit[part == p]
                    np.bitwise_or.at(parts.setdefault(p, np.zeros(1 << (segment - 3), np.uint8)), at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            for p, words in parts.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([words.tobytes()], pa.binary())], names=["part", "words"])

        words = np.zeros(1 << (bits - 3), np.uint8)
        for r in slots.repartition("part").mapInArrow(run, "part long, words binary").collect():
            words[r.part << (segment - 3) : (r.part + 1) << (segment - 3)] |= np.frombuffer(r.words, np.uint8)
        return cls(bits, words)

    def _slots(self, values: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return [values & low, values >> np.uint64(64 - self.bits)]

    def has(self, values: np.ndarray) -> np.ndarray:
        """Positions of the values that may be in the filter."""
        left = np.arange(len(values))
        for i in (0, 1):
            at = self._slots(values[left])[i]
            left = left[(self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0]
        return left


def _shingles(data: np.ndarray, bounds: np.ndarray, sizes: list[int]):
    """Word borders and numbers, and for each shingle size the hashes and the first word of each shingle."""
    starts, ends = K.words(data, bounds, K.ALNUM)
    per_doc = K.counts(starts, bounds)
    word = K.span_hash(data, starts, ends, K.LOWER)
    out = []
    for k in sizes:
        h, n = _only(word, per_doc, k)
        out.append((K.mix(h + np.uint64(k)), n))
    return starts, ends, per_doc, out


def _only(word: np.ndarray, per_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the documents that have k words or more."""
    long = per_doc >= k
    h, some = K.shingles(word[np.repeat(long, per_doc)], per_doc[long], k)
    n = np.zeros(len(per_doc), np.int64)
    n[long] = some
    return h, n


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, win, len, shingles): every window of every item, its words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, data, bounds, _ in K.blocks(b.column(1)):
                low = K.LOWER[data]
                starts, ends = K.words(data, bounds, K.ALNUM)
                per_doc = K.counts(starts, bounds)
                at = np.cumsum(per_doc) - per_doc
                item, win, size, shingles = [], [], [], []
                for d in np.flatnonzero(per_doc).tolist():
                    text = [low[a:z].tobytes().decode() for a, z in zip(starts[at[d] : at[d] + per_doc[d]].tolist(), ends[at[d] : at[d] + per_doc[d]].tolist(), strict=True)]
                    n = min(window, len(text))
                    k = min(SHINGLE, n)
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    (h, _), = _shingles(data[lo:hi], np.array([0, hi - lo]), [k])[3]
                    for i in range(len(text) - n + 1):
                        item.append(ids[first + d])
                        win.append(" ".join(text[i : i + n]))
                        size.append(n)
                        shingles.append(h[i : i + n - k + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(win, pa.string()), pa.array(size, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], names=["item_id", "win", "len", "shingles"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "item_id string, win string, len int, shingles array<long>")


def _frequencies(docs: DataFrame, sizes: list[int], wanted: BitFilter) -> DataFrame:
    """(h, df): document frequencies, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, bounds, _ in K.blocks(b.column(0)):
                for h, n in _shingles(data, bounds, sizes)[3]:
                    at = wanted.has(h)
                    doc = np.repeat(np.arange(len(n)), n)[at]
                    h = h[at]
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    first, n_docs = np.unique(h[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(n_docs.astype(np.int64))], names=["h", "df"])

    return docs.select("text").mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def _hits(docs: DataFrame, sizes: list[int], window: int, wanted: BitFilter) -> DataFrame:
    """A row per document (h is null), one for each place of an indexed shingle, and one for all places of a shorter window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "digest", "n_words", "h", "pos", "low", "context"]
        for b in batches:
            for first, data, bounds, _ in K.blocks(b.column(1)):
                starts, ends, per_doc, found = _shingles(data, bounds, sizes)
                n = len(per_doc)
                rows = slice(first, first + n)
                none = pa.nulls(n, pa.int64())
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], b.column(2)[rows], pa.array(per_doc.astype(np.int64)), none, pa.nulls(n, lists), none, pa.nulls(n, pa.string())], names=names)
                word_at = np.cumsum(per_doc) - per_doc
                blank = K.LOWER[data].copy()
                blank[~K.ALNUM[data]] = 32
                for k, (h, m) in zip(sizes, found, strict=True):
                    at = wanted.has(h)
                    doc = np.repeat(np.arange(n), m)[at]
                    pos = at - (np.cumsum(m) - m)[doc]
                    if k < SHINGLE:
                        a, z = starts[word_at[doc] + pos], ends[word_at[doc] + pos + k - 1]
                        places: dict[tuple, list[int]] = {}
                        for d, x, text, p in zip(doc.tolist(), h[at].view(np.int64).tolist(), (b" ".join(blank[i:j].tobytes().split()) for i, j in zip(a.tolist(), z.tolist(), strict=True)), pos.tolist(), strict=True):
                            places.setdefault((d, x, text), []).append(p)
                        d, x, text = zip(*places, strict=True) if places else ((), (), ())
                        take = pa.array(first + np.array(d, np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(take), b.column(2).take(take), pa.array(per_doc[list(d)].astype(np.int64)), pa.array(x, pa.int64()), pa.array(list(places.values()), lists), pa.nulls(len(d), pa.int64()), pa.array([t.decode() for t in text], pa.string())], names=names
                        )
                        continue
                    for lo in range(0, len(at), 4096):
                        d, p = doc[lo : lo + 4096], pos[lo : lo + 4096]
                        low = np.maximum(p - (window - k), 0)
                        high = np.minimum(p + window, per_doc[d])
                        a, z = starts[word_at[d] + low], ends[word_at[d] + high - 1]
                        context = [b" ".join(blank[x:y].tobytes().split()).decode() for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                        take = pa.array(first + d)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(take), b.column(2).take(take), pa.array(per_doc[d].astype(np.int64)), pa.array(h[at[lo : lo + 4096]].view(np.int64)), pa.array(p.astype(np.int64)[:, None].tolist(), lists), pa.array(low.astype(np.int64)), pa.array(context)], names=names
                        )

    return docs.mapInArrow(run, "id long, digest binary, n_words long, h long, pos array<long>, low long, context string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """Judge every row of ``docs``: columns ``RESULT``. It is contaminated if hit words are 1 / share of it or more."""
    spark = common.session(docs.sparkSession)
    used: list[str] = []
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    all_windows = common.staged(windows(benchmark, item_col, item_text_col, window), "windows", used)
    distinct = all_windows.groupBy("win").agg(F.min("len").alias("len"), F.min("shingles").alias("shingles"))
    inside = common.staged(distinct.select("win", "len", F.posexplode("shingles").alias("offset", "h")), "shingles", used)
    n = inside.select("h").distinct().count()
    sizes = sorted(r.k for r in all_windows.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect())

    frequency = _frequencies(base, sizes, BitFilter.over(inside, "h", n))
    ranked = inside.join(frequency, "h", "left").groupBy("win", "len")
    # the rarest shingle of a window decides; one that no document has rules the window out
    prefix = ranked.agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("x")).where("x.df > 0")
    prefix = common.staged(prefix.select("win", F.col("len"), F.col("x.h").alias("h"), F.col("x.offset").alias("offset")), "prefix", used)
    n = prefix.select("h").distinct().count()
    hits = common.staged(_hits(base.withColumn("digest", F.unhex(F.md5("text"))), sizes, window, BitFilter.over(prefix, "h", n)), "hits", used)

    # one row per place: copies of a text have the same hits
    places = hits.where("h IS NOT NULL").dropDuplicates(["digest", "h", "pos", "context"])
    match = places.join(prefix, "h").withColumn("start", F.explode(F.transform("pos", lambda p: p - F.col("offset"))))
    words = F.slice(F.split("context", " "), (F.col("start") - F.col("low") + 1).cast("int"), F.col("len"))
    inside_ = (F.col("start") >= F.col("low")) & (F.col("start") + F.col("len") <= F.col("n_words"))
    same = F.when(F.col("low").isNull(), F.col("context") == F.col("win")).otherwise(inside_ & (F.array_join(F.when(inside_, words), " ") == F.col("win")))
    match = common.staged(match.where(same).select("digest", "start", "len", "win"), "matches", used)

    order = W.partitionBy("digest").orderBy("start")
    spans = match.groupBy("digest", "start").agg((F.col("start") + F.max("len")).alias("stop"))
    before = F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", before))).groupBy("digest").agg(F.sum("new").alias("n_hit"))
    items = match.select("digest", "win").distinct().join(all_windows.select("win", "item_id").distinct(), "win").select("digest", "item_id").distinct()
    items = items.groupBy("digest").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    judged = common.staged(covered.join(items, "digest"), "judged")
    out = hits.where("h IS NULL").select(F.col("id").alias("doc_id"), "digest", "n_words").join(judged, "digest", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    out = out.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    common.drop(spark, *(p for p in used if "/hits-" not in p))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
