"""Operator 11: phrases of two to five words that occur more often than their parts would suggest.

Texts are cut at punctuation and line ends into pieces, and these into words. Counting goes through suffix arrays of word
ids, one per shard of about ``SHARD`` words: prefix doubling in NumPy sorts the suffixes by their first words, neighbours
with a common prefix of m words form the LCP interval of an m-word phrase, and its width is the phrase's count in the
shard. Counts of equal keys are merged over all shards. A phrase cannot be frequent unless its parts are, so there is a
round for each length, over what the one before has left:

1. Words: each shard's dictionary is merged by (language, word). Frequent words get a number.
2. to 5. Each shard counts its phrases of m words by buckets of a hash and sends the buckets' places and counts, packed, by ranges of
   buckets. A phrase may be frequent if its bucket is so in all shards together; the shards are told which of their buckets are,
   a bit for each. Only phrases in those are sent themselves: LCP intervals of m words, as the words' numbers and a count, packed by
   ranges too, and merged by the numbers. Phrases that share a bucket cost room; what is frequent is decided by the exact counts alone.

After the first round the frequent words go back to the shards that hold them, as places in the shard; after each, a shard keeps
only the runs of words in which every such phrase may be frequent. Both are bounded by the shard's size.

Numbers are exact: a word's is the least (shard, place in its dictionary) that holds it. A key occurs once per shard at
most, so no key is hot. Shards are cut anywhere; each carries the next words of its last piece along, which phrases may
reach into but not start from.

Then every way to cut a candidate in two is scored in exact decimal arithmetic, candidates that a longer one contains just
as often are dropped, and each language's first ones are ranked (first within slices, so that no task ranks a language).

Defined cases: null and empty texts have no words; a null language is ``und``; ids play no part, repeated rows count again;
an empty table has no phrases; ties in the score are ordered by count, then by the phrase's bytes; only the text and the language
column are read. Products stay below 10**38, which holds up to 10**17 words in a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import kernels as K

#: Words in a shard.
SHARD = 1 << 21
#: Places in a shard that a number leaves room for; a shard has fewer words than that, breaks included.
CODES = 1 << 24
#: Shards of a task that a number leaves room for.
PER_TASK = 1 << 12
MOST_WORDS = 5
#: Bits of a bucket's number. More phrases than buckets would cost room, not results.
BITS = 32
#: Ranges of buckets at least and at most; between them there is one for each shard, so that a range holds what a shard does.
RANGES = 64, 4096
_SPLIT = K.table(".,;:!?\n\x0b\x0c\r")
_WORD = ~(_SPLIT | K.table(" \t"))
_STEP = 8 << 20
ROWS = 1 << 16
_DICTIONARY = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
SHARDS = "shard long, starts int, low binary, high binary, breaks binary, dictionary binary, words map<string, long>"
STATE = "shard long, starts int, low binary, high binary, numbers binary"
_STATE = pa.schema([("shard", pa.int64()), ("starts", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("numbers", pa.binary())])
SKETCH = "shard long, range int, low binary, high binary, n binary"
ROUND = f"{STATE}, range int, keys binary, n binary"
_ROUND = pa.schema([*_STATE, ("range", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_MERGED = pa.schema([("g", pa.list_(pa.int64())), ("a", pa.int64())])
_VERDICTS = pa.schema([("shard", pa.int64()), ("range", pa.int32()), ("good", pa.binary())])


def _packed(schema: pa.Schema, columns: list[pa.Array]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        w.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    return out.getvalue().to_pybytes()


def _planes(code: np.ndarray) -> tuple[bytes, bytes]:
    """Codes as their lower 16 bits and the byte above; the second is nearly all zero and compresses away."""
    return code.astype("<u2").tobytes(), (code >> 16).astype(np.uint8).tobytes()


def _codes(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, np.uint8).astype(np.int64) << 16


def _dense(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below ``size``, and each key's place among them."""
    if size > 1 << 26:
        return np.unique(key, return_inverse=True)
    there = np.zeros(size, bool)
    there[key] = True
    place = np.cumsum(there, dtype=np.int32) - 1
    return np.flatnonzero(there), place[key]


class _Buffer:
    """Words that wait for their shard: letters, lengths, language codes, and whether a piece begins."""

    def __init__(self, size: int):
        self.size = size
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.langs: dict[str, int] = {}
        self.n, self.made = 0, 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.n += len(part[1])

    def shard(self, last: bool = False) -> pa.RecordBatch:
        """The next shard; the words beyond it stay."""
        letters, length, lang, begins = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        starts = self.n if last else self.size
        held = self.n if last else self.size + MOST_WORDS - 1
        at = np.concatenate([[0], np.cumsum(length)])
        self.parts = [] if last else [(letters[at[starts] :], length[starts:], lang[starts:], begins[starts:])]
        self.n -= starts
        text = pa.LargeStringArray.from_buffers(held, pa.py_buffer(at[: held + 1].astype(np.int64)), pa.py_buffer(letters[: at[held]])).dictionary_encode()
        key = np.asarray(text.indices).astype(np.int64) * len(self.langs) + lang[:held]
        keys, code = _dense(key, len(text.dictionary) * len(self.langs))
        names = np.array(list(self.langs), object)
        of = (keys % len(self.langs)).astype(np.int64)
        n = np.bincount(code[:starts], minlength=len(keys))
        words = text.dictionary.take(pa.array(keys // len(self.langs))).cast(pa.string())
        dictionary = _packed(_DICTIONARY, [pa.array(names[of], pa.string()), words, pa.array(n)])
        per_lang = np.bincount(lang[:starts], minlength=len(names))
        totals = [(names[i], int(per_lang[i])) for i in np.flatnonzero(per_lang).tolist()]
        if self.made >= PER_TASK:
            raise ValueError(f"more than {PER_TASK} shards in a task; read the texts in smaller partitions")
        number = TaskContext.get().partitionId() * PER_TASK + self.made
        self.made += 1
        low, high = _planes(code)
        columns = [[number], [starts], [low], [high], [np.packbits(begins[:held]).tobytes()], [dictionary], [totals]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.map_(pa.string(), pa.int64())]
        names_ = ["shard", "starts", "low", "high", "breaks", "dictionary", "words"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names_)


def _words(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(letters, lengths, documents, whether a piece begins) of the words of a block, in steps of bounded size."""
    low, open_, previous = 0, False, -1
    while low < len(data):
        high = min(len(data), low + _STEP)
        while high < len(data) and _WORD[data[high]] and _WORD[data[high - 1]]:
            more = np.flatnonzero(~_WORD[data[high : high + K.SLICE]])
            high = high + int(more[0]) if len(more) else min(len(data), high + K.SLICE)
        part = K.LOWER[data[low:high]]
        a, z = np.searchsorted(bounds, [low, high], "right")
        cut = np.unique(np.concatenate([[0], bounds[a:z] - low, [high - low]]))
        first, last = K.words(part, cut, _WORD)
        doc = np.searchsorted(bounds, first + low, "right") - 1
        pieces = np.concatenate([[0], np.cumsum(_SPLIT[part], dtype=np.int64)])
        begins = np.ones(len(first), bool)
        if len(first):
            begins[1:] = (pieces[first[1:]] != pieces[first[:-1]]) | (doc[1:] != doc[:-1])
            begins[0] = not (open_ and pieces[first[0]] == 0 and doc[0] == previous)
            previous, open_ = doc[-1], pieces[-1] == pieces[first[-1]]
            yield part[_WORD[part]], last - first, doc, begins
        else:
            open_ = open_ and pieces[-1] == 0
        low = high


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """Shards of words as codes, each with its own dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buffer(size)
        for b in batches:
            lang = pc.dictionary_encode(b.column(1))
            code = np.array([held.langs.setdefault(x, len(held.langs)) for x in lang.dictionary.to_pylist()], np.int64)[np.asarray(lang.indices)]
            for first, data, bounds, _ in K.blocks(b.column(0)):
                for letters, length, doc, begins in _words(data, bounds):
                    held.add(letters, length, code[first + doc], begins)
                    while held.n >= size + MOST_WORDS:
                        yield held.shard()
                        pa.default_memory_pool().release_unused()
        if held.n:
            yield held.shard(last=True)

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, SHARDS)


def _entries(shards: DataFrame) -> DataFrame:
    """The shards' dictionaries as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with pa.ipc.open_stream(packed) as r:
                    t = r.read_next_batch()
                for lo in range(0, len(t), ROWS):
                    part = t.slice(lo, ROWS)
                    code = np.arange(lo, lo + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array(code), *part.columns], ["shard", "code", "lang", "word", "n"])

    return shards.select("shard", "dictionary").mapInArrow(run, "shard long, code int, lang string, word string, n long")


def suffix_array(code: np.ndarray, depth: int) -> np.ndarray:
    """Positions other than breaks (code 0), sorted by their first ``depth`` codes up to a break: prefix doubling."""
    at = np.flatnonzero(code)
    rank, h = code, 1

    def key(shift: int) -> np.ndarray:
        out = rank[at] * (int(rank.max(initial=0)) + 1)
        inside = at + shift < len(code)
        out[inside] += rank[at[inside] + shift]
        return out

    while 2 * h < depth:
        _, dense = np.unique(key(h), return_inverse=True)
        rank = np.zeros(len(code), np.int64)
        rank[at] = dense + 1
        h *= 2  # suffixes that end sooner may be told apart by what follows their break; their prefixes stay together
    return at[np.argsort(key(depth - h) if depth > h else rank[at], kind="stable")]


def intervals(code: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with m codes before a break in the order of the suffix array, and where its LCP intervals of m codes begin."""
    order = suffix_array(code, m)
    padded = np.concatenate([code, np.zeros(m, code.dtype)])
    room, lcp = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)
    inside, alike = np.ones(len(order), bool), np.ones(max(len(order) - 1, 0), bool)
    for j in range(m):
        here = padded[order + j]
        inside &= here != 0
        room += inside
        alike &= inside[1:] & (here[1:] == here[:-1])
        lcp[1:] += alike
    # a shorter suffix shares less than m codes with every other one, so it is an interval of its own
    return order[room >= m], np.flatnonzero(lcp[room >= m] < m)


def _runs(word: np.ndarray, link: np.ndarray, m: int, starts: int) -> tuple[np.ndarray, int]:
    """The runs of words whose phrases of m - 1 words are all frequent, a break after each, and where what is only carried along begins.

    link[i]: the phrases of m - 1 words at i and at i + 1 are, so a phrase of m words at i may be. Each such i is in one run;
    words at the ends of runs may come twice.
    """
    edge = np.diff(np.concatenate([[0], link.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)  # links first..last-1: words first..last+m-2
    length = last - first + m - 1
    begin = np.cumsum(length + 1) - (length + 1)
    seq = np.zeros(int((length + 1).sum()), np.int64)
    at = np.repeat(begin, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    seq[at] = word[at - np.repeat(begin - first, length)]
    k = int(np.searchsorted(last, starts, "right"))  # the first run with a link at ``starts`` or later
    return seq, len(seq) if k == len(first) else int(begin[k]) + max(0, starts - int(first[k]))


def _state(shard: int, seq: np.ndarray, starts: int, numbers: bytes) -> pa.Table:
    low, high = _planes(seq)
    return pa.table({"shard": [shard], "starts": [starts], "low": [low], "high": [high], "numbers": [numbers]}, _STATE)


def _numbered(shard: pa.Table, found: pa.Table) -> pa.Table:
    """A shard's runs of frequent words, with codes of its own for them."""
    if not len(shard) or not len(found):
        return _STATE.empty_table()
    row = shard.to_pylist()[0]
    code = _codes(row["low"], row["high"])
    begins = np.unpackbits(np.frombuffer(row["breaks"], np.uint8), count=len(code)).astype(bool)
    mine = np.asarray(found.column("code").combine_chunks())
    order = np.argsort(mine, kind="stable")
    numbers = np.asarray(found.column("number").combine_chunks())[order]
    new = np.zeros(int(code.max(initial=0)) + 1, np.int64)
    new[mine[order]] = np.arange(1, len(mine) + 1)
    word = new[code]
    link = (word[1:] > 0) & (word[:-1] > 0) & ~begins[1:]
    return _state(row["shard"], *_runs(word, link, 2, row["starts"]), numbers.tobytes())


def _buckets(code: np.ndarray, numbers: np.ndarray, m: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with m codes before a break, and the bucket of each one's m words."""
    word = np.concatenate([np.zeros(1, np.uint64), K.mix(numbers.astype(np.uint64))])
    padded = np.concatenate([code, np.zeros(m, code.dtype)])
    inside, h = np.ones(len(code), bool), np.zeros(len(code), np.uint64)
    for j in range(m):
        here = padded[j : j + len(code)]
        inside &= here != 0
        h = K.mix(h * K.BASE + word[here])
    at = np.flatnonzero(inside)
    return at, (h[at] >> np.uint64(64 - bits)).astype(np.uint32)


def _borders(distinct: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each range of buckets begins among a shard's buckets, and the end."""
    return np.searchsorted(distinct, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(bits) >> np.uint64(ranges.bit_length() - 1))


def _sketches(state: DataFrame, m: int, least: int, ranges: int, bits: int) -> DataFrame:
    """Each shard's buckets of phrases of m words in order, and how many start in the shard (``least`` stands for more), by ranges."""
    narrow = np.uint8 if least < 1 << 8 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at, bucket = _buckets(_codes(row["low"], row["high"]), np.frombuffer(row["numbers"], np.int64), m, bits)
                distinct, n = np.unique(bucket, return_counts=True)
                np.subtract.at(n, np.searchsorted(distinct, bucket[at >= row["starts"]]), 1)
                n, border = np.minimum(n, least).astype(narrow), _borders(distinct, ranges, bits)
                full = np.flatnonzero(np.diff(border))
                parts = [(distinct[border[r] : border[r + 1]], n[border[r] : border[r + 1]]) for r in full.tolist()]
                columns = [pa.array([(k & 0xFFFF).astype("<u2").tobytes() for k, _ in parts], pa.binary()), pa.array([(k >> 16).astype("<u2").tobytes() for k, _ in parts], pa.binary())]
                columns.append(pa.array([c.tobytes() for _, c in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), row["shard"])), pa.array(full.astype(np.int32)), *columns], ["shard", "range", "low", "high", "n"])

    return state.select("shard", "starts", "low", "high", "numbers").mapInArrow(run, SKETCH)


def _verdicts(least: int):
    """Which of the shards' buckets of a range are frequent in all of them together; shards without such a bucket are left out."""
    narrow = np.uint8 if least < 1 << 8 else np.uint32

    def run(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        keys = [np.frombuffer(r["low"], "<u2").astype(np.uint32) | np.frombuffer(r["high"], "<u2").astype(np.uint32) << 16 for r in rows]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([np.frombuffer(r["n"], narrow) for r in rows]))
        good = np.split((total >= least)[place], np.cumsum([len(k) for k in keys])[:-1])
        told = [(r["shard"], r["range"], np.packbits(g).tobytes()) for r, g in zip(rows, good, strict=True) if g.any()]
        return pa.table([pa.array([t[i] for t in told], f.type) for i, f in enumerate(_VERDICTS)], schema=_VERDICTS)

    return run


def _narrowed(m: int, ranges: int, bits: int):
    """A shard's phrases of m words that may be frequent, by ranges of buckets, and its runs of these."""

    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        if not len(state) or not len(told):
            return _ROUND.empty_table()
        row = state.to_pylist()[0]
        code, numbers = _codes(row["low"], row["high"]), np.frombuffer(row["numbers"], np.int64)
        at, bucket = _buckets(code, numbers, m, bits)
        distinct = np.unique(bucket)
        border, good = _borders(distinct, ranges, bits), np.zeros(len(distinct), bool)
        for r, packed in zip(told.column("range").to_pylist(), told.column("good").to_pylist(), strict=True):
            good[border[r] : border[r + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=border[r + 1] - border[r])
        may = np.zeros(len(code), bool)
        may[at] = good[np.searchsorted(distinct, bucket)]
        order, head = intervals(code, m)
        n = np.add.reduceat((order < row["starts"]).astype(np.int64), head)
        first = order[head]
        sent = may[first] & (n > 0)
        first, n, of = first[sent], n[sent], np.zeros(len(code), np.uint32)
        of[at] = bucket >> np.uint32(bits - ranges.bit_length() + 1)
        keys = np.stack([numbers[code[first + j] - 1] for j in range(m)])
        order = np.lexsort((*keys[::-1], of[first]))
        keys, n, of = keys[:, order], n[order].astype("<u4"), of[first][order]
        full, border = np.unique(of, return_index=True)
        parts = [slice(lo, hi) for lo, hi in zip(border.tolist(), [*border[1:].tolist(), len(of)], strict=True)] if len(full) else []
        columns = [pa.array(full.astype(np.int32)), pa.array([keys[:, x].tobytes() for x in parts], pa.binary()), pa.array([n[x].tobytes() for x in parts], pa.binary())]
        out = [pa.table([*(pa.nulls(len(full), f.type) for f in _STATE), *columns], schema=_ROUND)]
        if m < MOST_WORDS:
            seq, starts = _runs(code, may[:-1] & may[1:], m + 1, row["starts"])
            left = _state(row["shard"], seq, starts, row["numbers"])
            out.append(pa.table([*left.columns, *(pa.nulls(1, f.type) for f in list(_ROUND)[len(_STATE) :])], schema=_ROUND))
        return pa.concat_tables(out)

    return run


def _merged(m: int, least: int):
    """The frequent phrases of m words of a range, by the words' numbers, from the shards' counts."""

    def run(found: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64).reshape(m, -1) for x in found.column("keys").to_pylist()], axis=1)
        n = np.concatenate([np.frombuffer(x, "<u4") for x in found.column("n").to_pylist()]).astype(np.int64)
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        head = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        a = np.add.reduceat(n[order], head)
        good = a >= least
        g = keys[:, head[good]]
        return pa.table([pa.ListArray.from_arrays(pa.array(np.arange(g.shape[1] + 1, dtype=np.int32) * m), pa.array(g.T.ravel())), pa.array(a[good])], schema=_MERGED)

    return run


def count_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", size: int = SHARD, paths: list[str] | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words in each language, frequent words with their numbers, frequent phrases of any length as number arrays)."""
    spark = common.session(docs.sparkSession)
    left: list[str] = []
    cut = common.staged(shards(docs, text_col, lang_col, size), "phrases-shards", left)
    shards_ = cut.count()
    totals = common.staged(cut.select(F.explode("words").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals", paths)
    # a dictionary holds a word once, so no key is hot: it has a row per shard at most, and needs no join to find its way back
    same = Window.partitionBy("lang", "word")
    place = F.col("shard") * CODES + F.col("code") + 1
    words = _entries(cut).select("*", F.sum("n").over(same).alias("a"), F.min(place).over(same).alias("number")).where(F.col("a") >= least)
    first = F.col("number") == place
    words = common.staged(words.select("shard", "code", "number", *(F.when(first, F.col(c)).alias(c) for c in ("lang", "word", "a"))), "phrases-words", paths)
    known = words.where("a IS NOT NULL").select("number", "lang", "word", "a")
    state = cut.select("shard", "starts", "low", "high", "breaks").groupBy("shard").cogroup(words.select("shard", "code", "number").groupBy("shard")).applyInArrow(_numbered, STATE)
    state = common.staged(state, "phrases-state", left)
    common.drop(spark, *left[:-1])
    left = left[-1:]
    ranges = 1 << (min(max(RANGES[0], shards_), RANGES[1]) - 1).bit_length()
    phrases = known.select(F.array("number").alias("g"), "a")
    for m in range(2, MOST_WORDS + 1):
        told = _sketches(state, m, least, ranges, bits).groupBy("range").applyInArrow(_verdicts(least), "shard long, range int, good binary")
        both = state.select("shard", "starts", "low", "high", "numbers").groupBy("shard").cogroup(told.groupBy("shard"))
        both = common.staged(both.applyInArrow(_narrowed(m, ranges, bits), ROUND), f"phrases-round-{m}", left)
        common.drop(spark, *left[:-1])
        left = left[-1:]
        found = both.where("range IS NOT NULL").select("range", "keys", "n").groupBy("range").applyInArrow(_merged(m, least), "g array<long>, a long")
        phrases = phrases.unionByName(common.staged(found, f"phrases-found-{m}", paths))
        state = both.where("range IS NULL")
    common.drop(spark, *left)
    return totals, known, common.staged(phrases, "phrases", paths)


def collocations(docs: DataFrame, least: int = 100, inside: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score. ``size``: words in a shard.

    ``least``: the least count of a candidate. ``inside``: a candidate is dropped if a longer one that contains it has so many
    hundredths of its count. It is enough to look one word further: of the candidates between the two, one that is a
    word longer occurs at least as often as the longer one.
    """
    totals, known, phrases = count_phrases(docs, least, text_col, lang_col, size)
    length = F.size("g")
    candidates = phrases.where(length > 1)
    longer = candidates.where(length > 2).select(F.explode(F.array(F.slice("g", 1, length - 1), F.slice("g", 2, length - 1))).alias("g"), F.col("a").alias("longer"))
    most = longer.groupBy("g").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    kept = candidates.join(most, "g", "left").where(F.col("longer").isNull() | (100 * wide("longer") < inside * wide("a"))).drop("longer")
    cuts = kept.select("g", "a", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("left"), F.slice("g", F.col("k") + 1, length - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select(F.col("g").alias("left"), F.col("a").alias("l")), "left").join(phrases.select(F.col("g").alias("right"), F.col("a").alias("r")), "right")
    first = known.select(F.col("number").alias("g1"), "lang")
    cuts = cuts.withColumn("g1", F.col("g")[0]).join(first, "g1").join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr("(1000 * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))"))
    scored = cuts.groupBy("lang", "g", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "g", "a", "n", "s.l", "s.r", "s.score")
    spelled = scored.select("g", F.posexplode("g").alias("i", "number")).join(known.select("number", "word"), "number")
    spelled = spelled.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w")).select("g", F.concat_ws(" ", "w.word").alias("phrase"))
    scored = scored.join(spelled, "g")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may have any number of candidates: slices of it are ranked first, and leave ``top`` rows each
    slices = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    slices = slices.withColumn("at", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("at") <= top)
    ranked = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
