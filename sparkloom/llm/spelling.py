"""Operator 13: groups of spelling variants, by minimal automata of the vocabulary searched with one error.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced letter (code point) tells them
apart. One half of the shorter word is then the same in both, at its begin or at its end: an automaton of the words read
forward, or of the words read backward, is followed exactly through that half, and the rest is completed with one error
(``Automaton.one_error``). The number that the automaton gives a word finds its count.

The vocabulary is dealt out: a word of t letters lies in the block of its length and its first (t - 1) // 2 letters, for
the backward automata its last ones, which is as much as any word near it is sure to share. A word asks the blocks of its own
length and of one letter more, in both directions. A task holds the blocks that hash to it, one automaton over them all. A
block of more than ``BLOCK`` words is split over several tasks by a hash of the word, and its questions go to each.
The number of tasks follows the vocabulary, so none holds more than about ``PART`` words.

Each near pair is found in one way only: a backward find that the forward direction has too is left out, an added letter is
added after its equals, and words of one length ask each other. So a task sums its finds before they are shuffled: a row per
question and block, not one per pair.

Each word's form is its nearest word by count; forms are followed to their roots by pointer doubling, which ends as a
form occurs ``times`` as often as its word.

Defined cases: a null text has no words; a null id counts as an empty one in the hash that drops letters; repeated rows count
again; an empty table has no words; ties in the count go to the smallest word; only id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .automaton import Automaton

#: About the most words in a task's automaton, and in one block of it.
PART = 1 << 16
BLOCK = 1 << 14
#: Questions that are followed at once.
QUESTIONS = 1 << 14
_HELD = 1 << 20
_STEP = 8 << 20
_ASCII = K.table("abcdefghijklmnopqrstuvwxyz")
_MARK = np.array([i == 1 for i in range(256)])
FOUND = "word string, n_near long, best_n long, best string"


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32: a byte's polynomial remainder."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, continued from the CRC-32 of what stands before it; a byte of all spans at a time."""
    size = ends - starts
    out = np.empty(len(starts), np.int64)
    for i in np.flatnonzero(size > 256).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].data, int(before[i]))
    short = np.flatnonzero(size <= 256)
    short = short[np.argsort(-size[short], kind="stable")]
    many = np.searchsorted(-size[short], -np.arange(1, int(size[short].max(initial=0)) + 1), "right")
    c = ~before[short].astype(np.uint32)
    at = starts[short]
    for j, n in enumerate(many.tolist()):
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[short] = ~c
    return out


def _runs(ids: list[int | None], data: np.ndarray, bounds: np.ndarray, drop: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(letters, lengths in bytes) of the words of a block, after dropped letters, in steps of bounded size.

    Letters are ASCII ones and U+00C0 to U+00FF, which all are two bytes, the first of them C3.
    """
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    low = 0
    while low < len(data):
        high = min(len(data), low + _STEP)
        while high < len(data) and (_ASCII[K.LOWER[data[high]]] or data[high] == 0xC3 or data[high - 1] == 0xC3):
            high += 1
        part = K.LOWER[data[low:high]]
        mark = _ASCII[part] | (part == 0xC3)
        mark[1:] |= part[:-1] == 0xC3
        cut = np.unique(np.concatenate([[0], bounds[(bounds > low) & (bounds < high)] - low, [high - low]]))
        starts, ends = K.words(mark.astype(np.uint8), cut, _MARK)
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)])
        length = points[ends] - points[starts]
        keep = length >= least  # a word that loses a letter had one more
        starts, ends, length = starts[keep], ends[keep], length[keep]
        doc = np.searchsorted(bounds, starts + low, "right") - 1
        h = crc32(part, starts, ends, prefix[doc])
        gone = np.flatnonzero(h % drop == 0) if drop else np.zeros(0, np.int64)
        length[gone] -= 1
        place = np.searchsorted(points, points[starts[gone]] + h[gone] % (length[gone] + 1) + 1) - 1
        size = ends - starts
        wide = part[place] == 0xC3
        size[gone] -= 1 + wide
        change = np.zeros(len(part) + 1, np.int8)
        good = length >= least
        change[starts[good]] += 1
        change[ends[good]] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        inside[place] = False
        inside[place[wide] + 1] = False
        yield part[inside], size[good]
        low = high


def count_words(docs: DataFrame, drop: int = 31, least: int = 7, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least`` letters that occur at least ``times`` times.

    Every ``drop``-th run of letters (by the hash of its document and itself) loses a letter; 0: none does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            letters, size = (np.concatenate([x[i] for x in held]) for i in range(2))
            at = np.concatenate([[0], np.cumsum(size)])
            words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters)))
            found = pc.value_counts(words)
            return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for first, data, bounds, _ in K.blocks(b.column(1)):
                for part in _runs(ids[first : first + len(bounds) - 1], data, bounds, drop, least):
                    held.append(part)
                    n += len(part[1])
                    if n >= _HELD:
                        yield counted()
                        held, n = [], 0
        if n:
            yield counted()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class _Words:
    """Words as code points, laid end to end."""

    def __init__(self, words: list[str], backward: bool):
        self.words = words
        self.chars = np.frombuffer("".join(w[::-1] if backward else w for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(np.array([len(w) for w in words], np.int64))]).astype(np.int64)

    def sorted(self) -> tuple[_Words, np.ndarray]:
        """In the order of their code points, and which word each one was."""
        texts = np.array([self.chars[a:z].astype(">u4").tobytes() for a, z in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)] or [b""], object)[: len(self.words)]
        order = np.argsort(texts, kind="stable")
        out = object.__new__(_Words)
        out.words = [self.words[i] for i in order.tolist()]
        size = np.diff(self.bounds)[order]
        out.bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        out.chars = self.chars[np.repeat(self.bounds[order] - out.bounds[:-1], size) + np.arange(int(size.sum()))]
        return out, order


class _Part:
    """One task's words, and the answers to the questions that meet them."""

    def __init__(self, backward: bool, words: list[str], n: np.ndarray):
        self.backward = backward
        self.words, order = _Words(words, backward).sorted()
        self.n = n[order]
        self.automaton = Automaton(self.words.chars, self.words.bounds)
        # the order of the words as they are read
        self.place = np.argsort(np.argsort(np.array(self.words.words, object), kind="stable"), kind="stable") if backward else np.arange(len(words))

    def answer(self, words: list[str], n: np.ndarray, longer: np.ndarray) -> Iterator[pa.RecordBatch]:
        for more in (False, True):
            at = np.flatnonzero(longer == more)
            if not len(at):
                continue
            asked = _Words([words[i] for i in at.tolist()], self.backward)
            length = np.diff(asked.bounds)
            half = length // 2
            query, found = self.automaton.one_error(asked.chars, asked.bounds, length - half if self.backward else half, more)
            if self.backward and more:
                query, found = self._not_forward(asked, half, query, found)
            if not len(query):
                continue
            yield self._best(asked.words, query, self.words.words, found, self.n[found], self.place[found])
            if more:
                mine = n[at]
                rank = np.argsort(np.argsort(np.array(asked.words, object), kind="stable"), kind="stable")
                yield self._best(self.words.words, found, asked.words, query, mine[query], rank[query])

    def _not_forward(self, asked: _Words, half: np.ndarray, query: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without those whose first half is equal as well: they are found forward. Both are read backward here."""
        same = np.ones(len(query), bool)
        for j in range(int(half.max(initial=0))):
            on = np.flatnonzero(same & (half[query] > j))
            same[on] = asked.chars[asked.bounds[query[on] + 1] - 1 - j] == self.words.chars[self.words.bounds[found[on] + 1] - 1 - j]
        return query[~same], found[~same]

    @staticmethod
    def _best(words: list[str], of: np.ndarray, near: list[str], which: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """For each word: how many near ones, and the most frequent one, of equals the first in code-point order."""
        order = np.lexsort((place, -n, of))
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        many = np.diff(np.append(first, len(order)))
        at = order[first]
        columns = [pa.array([words[i] for i in of[at].tolist()]), pa.array(many), pa.array(n[at]), pa.array([near[i] for i in which[at].tolist()])]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """For each word of (word, n) that has near ones: their number, and the most frequent one with its count."""
    spark = words.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // PART))
    parts = -(-parts // 2)  # for each direction
    letters = F.char_length("word")
    kinds = [F.struct(F.lit(d).alias("backward"), (letters + more).alias("t"), F.lit(asks).alias("asks"), F.lit(more).alias("longer")) for d in (0, 1) for more, asks in ((0, 0), (0, 1), (1, 1))]
    rows = words.select("word", "n", F.explode(F.array(*kinds)).alias("x")).select("word", "n", "x.*")
    held = F.expr("(t - 1) div 2").cast("int")
    rows = rows.withColumn("key", F.when(F.col("backward") == 0, F.left("word", held)).otherwise(F.right("word", held)))
    own = rows.where("asks = 0")
    large = common.staged(own.groupBy("backward", "t", "key").count().where(F.col("count") > block), "spelling-blocks")
    large = large.select("backward", "t", "key", F.ceil(F.col("count") / block).cast("int").alias("split"))
    rows = rows.join(large, ["backward", "t", "key"], "left").withColumn("split", F.coalesce("split", F.lit(1)))
    slot = F.pmod(F.xxhash64("word"), F.col("split")).cast("int")
    rows = rows.withColumn("slot", F.explode(F.when(F.col("asks") == 0, F.array(slot)).otherwise(F.sequence(F.lit(0), F.col("split") - 1))))
    part = (F.col("backward") * parts + F.pmod(F.xxhash64("t", "key", "slot"), F.lit(parts))).cast("int")
    rows = rows.select(part.alias("part"), "asks", "word", "longer", "n")
    dealt = rows.repartitionById(2 * parts, F.col("part")).sortWithinPartitions("part", "asks", "word", "longer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, asked, built, last = None, [], [], None, None

        def held(rows: list[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(rows)
            # a question that went to several slots of a block may come twice
            words, longer = t.column("word").to_pylist(), np.asarray(t.column("longer").combine_chunks())
            return words, np.asarray(t.column("n").combine_chunks()), longer

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal built, last
            if asked and own:
                if built is None:
                    words, n, _ = held(own)
                    built = _Part(at >= parts, words, n)
                words, n, longer = held(asked)
                new = np.array([(w, x) != y for w, x, y in zip(words, longer.tolist(), [last, *zip(words, longer.tolist(), strict=True)], strict=False)])
                last = (words[-1], int(longer[-1]))
                yield from built.answer([w for w, good in zip(words, new.tolist(), strict=True) if good], n[new], longer[new])
            asked.clear()

        for b in batches:
            part, asks = np.asarray(b.column(0)), np.asarray(b.column(1))
            cut = np.flatnonzero((np.diff(part, prepend=part[0] - 1) != 0) | (np.diff(asks, prepend=asks[0]) != 0))
            for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=True):
                if part[a] != at:
                    yield from answers()
                    at, built, last = int(part[a]), None, None
                    own.clear()
                (asked if asks[a] else own).append(b.slice(a, z - a))
                if sum(map(len, asked)) >= QUESTIONS:
                    yield from answers()
        yield from answers()

    found = dealt.mapInArrow(run, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def variants(words: DataFrame, times: int = 10, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of (word, n)."""
    spark = common.session(words.sparkSession)
    words = common.staged(words, "spelling-words")
    taken = F.col("best_n") >= times * F.col("n")
    rows = words.join(near_words(words, parts, block), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    rows = common.staged(rows, "spelling-forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, times)))  # the longest way: each step is to a word ``times`` as frequent
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for i in range(steps.bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = common.staged(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"spelling-roots-{i}")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, drop: int = 31, least: int = 7, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of the words of a corpus."""
    common.session(docs.sparkSession)
    return variants(count_words(docs, drop, least, id_col=id_col, text_col=text_col), times)
