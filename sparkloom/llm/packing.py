"""Operator 12: packing documents into sequences, shortest pack first over the histogram of lengths.

Documents become token ids with an end id. A document gives as many pieces of a whole sequence as it holds, and one piece
of what is left. The pieces of one length are alike, so packing needs their histogram only: at most ``capacity`` numbers,
however many documents there are. All sequences stand open from the start, as many as the tokens fill. Lengths are taken
longest first, and each goes to the packs that are shortest so far, as many at once as there are alike ones: a pattern and
its count are updated, not single packs. A piece that fits in no pack is cut: it fills the shortest pack, and what is left
of it returns to the histogram as a shorter length. So sequences end exactly full, and cuts come only where the last
packs close. A capacity that is a power of two leaves no padding at all: the tokens beyond the last full sequence go to
sequences of 2**k tokens, which need none (sequences are padded to the capacity, except at a power of two). With any other
capacity one last sequence is shorter than the rest and padded.

Patterns are joined back by rank. Equal patterns are neighbours by sequence id, so "the pieces of length l with ranks a to b
lie at offset o of sequences s, s + 1, ..." is one line of the plan, and the plan has at most about capacity**2 lines
whatever the input. Ranks come from two levels: a task counts within its own rows (a block), a prefix sum over blocks
gives the block's base for each length. A block is joined with its bases by (block, length), so no length, however
common, meets in one task, except for the prefix sum over the number of blocks.

Defined cases: a null text is an empty one; an empty text has the end id alone; null and repeated ids are documents of
their own; an empty table gives no piece; only the id and the text column are read. Which piece goes where depends on how the
input is split into tasks, so reruns over the same files agree; that each id lies in exactly one piece holds always.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .encoder import encoder

STAGED = "block int, id long, n long, rest int, rank long, wholes long, whole_rank long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ranks stay below 2**RANK_BITS, so that a length and a rank make one number.
RANK_BITS = 48


@dataclass
class Plan:
    """Lines of a packing plan, ascending by (length, first rank)."""

    key: np.ndarray  # length << RANK_BITS | first rank
    taken: np.ndarray  # how many tokens of the piece go here; less than the length where it is cut
    sequence: np.ndarray  # the sequence of the first rank; the following ranks take the following sequences
    offset: np.ndarray
    rest_rank: np.ndarray  # the rank of what is left of the first one among the pieces of that length

    def place(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which pieces, tokens before the part, tokens, sequence, offset), once for every further cut."""
        which, before = np.arange(len(length)), np.zeros(len(length), np.int64)
        while len(which):
            at = np.searchsorted(self.key, (length << RANK_BITS) | rank, "right") - 1
            step = rank - (self.key[at] & ((1 << RANK_BITS) - 1))
            taken = self.taken[at]
            yield which, before, taken, self.sequence[at] + step, self.offset[at]
            more = np.flatnonzero(taken < length)
            which, before, rank = which[more], (before + taken)[more], (self.rest_rank[at] + step)[more]
            length = (length - taken)[more]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan for so many pieces of each length from 1 to ``capacity``."""
    total = sum(length * n for length, n in histogram.items())
    full, rest = divmod(total, capacity)
    # packs that are alike: (-room, first sequence, how many, capacity); the heap gives the shortest ones
    packs = [(-capacity, 0, full, capacity)] if full else []
    if capacity & (capacity - 1):
        tails = [rest] if rest else []
    else:
        tails = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    packs += [(-size, full + i, 1, size) for i, size in enumerate(tails)]
    heapq.heapify(packs)
    count = dict(histogram)
    lines = []
    for length in range(capacity, 0, -1):
        rank, left = 0, count.get(length, 0)
        while left:
            room, first, many, size = heapq.heappop(packs)
            n, taken = min(left, many), min(length, -room)
            lines.append((length << RANK_BITS | rank, taken, first, size + room, count.get(length - taken, 0)))
            if taken < length:
                count[length - taken] = count.get(length - taken, 0) + n
            if n < many:
                heapq.heappush(packs, (room, first + n, many - n, size))
            if room + taken:
                heapq.heappush(packs, (room + taken, first, n, size))
            rank, left = rank + n, left - n
    lines.sort()
    return Plan(*(np.array([x[i] for x in lines], np.int64) for i in range(5)))


def encode(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Each document's ids, its pieces' lengths, and their ranks among the equally long ones of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        block = TaskContext.get().partitionId()
        seen, whole = np.zeros(capacity, np.int64), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for first, data, bounds, _ in K.blocks(b.column(1)):
                ids, at = enc.encode(data, bounds)
                raw, step = ids.tobytes(), ids.itemsize
                n = np.diff(at) + 1
                wholes, rest = n // capacity, n % capacity
                order = np.argsort(rest, kind="stable")
                start = np.searchsorted(rest[order], rest[order])
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - start + seen[rest[order]]
                seen += np.bincount(rest, minlength=capacity)
                before = np.cumsum(wholes) - wholes + whole
                whole += int(wholes.sum())
                out = pa.array([raw[a * step : z * step] + end for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                columns = [pa.array(np.full(len(n), block, np.int32)), b.column(0)[first : first + len(n)], pa.array(n), pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(wholes), pa.array(before), out]
                yield pa.RecordBatch.from_arrays(columns, ["block", "id", "n", "rest", "rank", "wholes", "whole_rank", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, STAGED)


def _bases(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bases by (block, rest), and by block for the whole sequences: how many such pieces the blocks before it have."""
    counted = staged.groupBy("block", "rest").agg(F.count("*").alias("n"), F.sum("wholes").alias("wholes"))
    rests = counted.select("block", "rest", "n", "wholes", (F.sum("n").over(Window.partitionBy("rest").orderBy("block")) - F.col("n")).alias("base"))
    wholes = counted.groupBy("block").agg(F.sum("wholes").alias("w"))
    # the one length that all blocks share: as many rows as there are blocks
    wholes = wholes.select("block", (F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy("block")) - F.col("w")).alias("whole_base"))
    return rests, wholes


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A row per piece: its document, its place in it and in the sequence, and (``with_ids``) its ids, ``width`` bytes each."""
    spark = common.session(docs.sparkSession)
    staged = common.staged(encode(docs, tokenizer, capacity, id_col, text_col, end_id), "packing")
    rests, wholes = _bases(staged)
    bases = common.staged(rests.join(wholes, "block"), "packing-bases")
    histogram = {r.rest: r.n for r in bases.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r.rest}
    histogram[capacity] = bases.agg(F.sum("wholes")).first()[0] or 0
    plan = shortest_pack_first(histogram, capacity)
    width = encoder(tokenizer).dtype
    rows = staged.join(bases.select("block", "rest", "base", "whole_base").hint("shuffle_hash"), ["block", "rest"])
    rows = rows.select("id", "n", "rest", (F.col("rank") + F.col("base")).alias("rank"), "wholes", (F.col("whole_rank") + F.col("whole_base")).alias("whole_rank"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rest, rank, wholes, whole_rank = (np.asarray(b.column(i)).astype(np.int64) for i in range(1, 6))
            # pieces: the whole ones of every document, then what is left of each
            doc = np.repeat(np.arange(len(n)), wholes)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(wholes) - wholes, wholes)
            short = np.flatnonzero(rest)
            doc = np.concatenate([doc, short])
            begin = np.concatenate([nth * capacity, (wholes * capacity)[short]])
            length = np.concatenate([np.full(len(nth), capacity, np.int64), rest[short]])
            place = np.concatenate([np.repeat(whole_rank, wholes) + nth, rank[short]])
            parts = list(plan.place(length, place))
            which = np.concatenate([p[0] for p in parts])
            before, taken, sequence, offset = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
            doc, begin = doc[which], begin[which] + before
            order = np.lexsort((begin, doc))
            doc, begin, taken, sequence, offset = (x[order] for x in (doc, begin, taken, sequence, offset))
            column = b.column(6)
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(n) + 1].astype(np.int64)
            ids = np.frombuffer(column.buffers()[2], width)[at[0] // width.itemsize : at[-1] // width.itemsize]
            first = (at[doc] - at[0]) // width.itemsize + begin
            for lo in range(0, len(doc), 4096):
                cut = slice(lo, lo + 4096)
                pieces = [ids[a:z] for a, z in zip(first[cut].tolist(), (first + taken)[cut].tolist(), strict=True)]
                crc = np.array([zlib.crc32(x.astype("<u4").data) for x in pieces], np.int64)
                columns = [b.column(0).take(pa.array(doc[cut])), pa.array(begin[cut]), pa.array(taken[cut]), pa.array(crc), pa.array(n[doc[cut]]), pa.array(sequence[cut]), pa.array(offset[cut])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.tobytes() for x in pieces], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else "")).select(*(f.strip().split()[0] for f in PIECES.split(",")), *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """A row per sequence: its ids one after the other, and where each piece begins and which document it is from.

    A sequence has at most ``capacity`` pieces, so its group is bounded.
    """
    part = F.struct("offset", "length", "doc_id", "start", "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda have, x: F.concat(have, x["ids"]))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("tokens"), ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
