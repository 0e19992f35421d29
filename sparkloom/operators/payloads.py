"""Known byte payloads in binaries of any size: one automaton finds their anchors, a SHA-256 of the whole range proves a match.

A binary is a run of slices. Each slice carries the first bytes of the next one, so an anchor that crosses a border is found
in the slice where it starts, and every slice is scanned on its own. A range that lies within its slice is proven there; for
one that crosses borders the slices that it covers are joined to it and hashed in order, one slice in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of an anchor and of a slice, and limits of a catalog and of one binary (fixed values).
ANCHOR, SLICE = 64, 1 << 20
MOST_SIGNATURES, MOST_LENGTH, MOST_CANDIDATES, MOST_MATCHES = 8, 64 << 20, 128, 16
_SLICES = "key long, idx long, content binary, carry binary"


@dataclass(frozen=True)
class Signature:
    """A payload: its length and SHA-256, and where in it the anchor bytes stand."""

    id: str
    length: int
    sha256: str
    anchor: bytes
    anchor_offset: int = 0


def checked(signatures: list[Signature]) -> list[Signature]:
    """A catalog within its bounds, or ValueError: 1 to 8 different payloads with well-formed ids, digests and anchors."""
    if not 0 < len(signatures) <= MOST_SIGNATURES:
        raise ValueError("a catalog has 1 to 8 signatures")
    for s in signatures:
        if not (ANCHOR <= s.length <= MOST_LENGTH and 0 <= s.anchor_offset <= s.length - ANCHOR):
            raise ValueError(f"bounds of signature {s.id}")
        if not (0 < len(s.id) <= 80 and re.fullmatch("[0-9a-f]{64}", s.sha256)):
            raise ValueError(f"identity of signature {s.id}")
        if len(s.anchor) != ANCHOR:
            raise ValueError(f"anchor of signature {s.id}")
    if len({(s.length, s.sha256) for s in signatures}) < len(signatures):
        raise ValueError("a payload is listed twice")
    return signatures


def cut(rows: DataFrame, key: str, content: str, size: int = SLICE) -> DataFrame:
    """(key, idx, content, carry): whole binaries as slices. A null or empty binary has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held = memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")
                for i, at in enumerate(range(0, len(held), size)):
                    part, carry = held[at : at + size], held[at + size : at + size + ANCHOR - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([i]), pa.array([part.tobytes()], pa.binary()), pa.array([carry.tobytes()], pa.binary())], ["key", "idx", "content", "carry"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, _SLICES)


def carried(slices: DataFrame) -> DataFrame:
    """Slices (key, idx, content) of one size, but for each binary's last one, with what they carry from the next ones.

    A slice of fewer bytes than an anchor needs more than one follower.
    """
    own = W.partitionBy("key").orderBy("idx")
    head = F.substring("content", 1, ANCHOR - 1)
    followers = F.concat(*(F.coalesce(F.lead(head, i).over(own), F.lit(b"")) for i in (1, 2)))
    return slices.select("key", "idx", "content", F.substring(followers, 1, ANCHOR - 1).alias("carry"))


def _candidates(slices: DataFrame, signatures: list[Signature], size: int) -> DataFrame:
    """(key, signature, start, proven): proven is null where the range leaves its slice.

    A slice gives at most one candidate more than a binary may have for each signature: later ones are past the limit.
    """
    offsets = {}
    for i, s in enumerate(signatures):
        offsets.setdefault(s.anchor, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for anchor, which in offsets.items():
            found.add_word(anchor.decode("latin-1"), which)
        found.make_automaton()
        for b in batches:
            out: dict[str, list] = {"key": [], "signature": [], "start": [], "proven": []}
            for k, i, content, carry in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                data, more = content.as_py(), carry.as_py()
                many = [0] * len(signatures)
                for last, which in found.iter((data + more).decode("latin-1")):
                    at = last - ANCHOR + 1
                    if at >= len(data):
                        break
                    for n in which:
                        many[n] += 1
                        if many[n] > MOST_CANDIDATES + 1:
                            continue
                        s = signatures[n]
                        a = at - s.anchor_offset
                        inside = a >= 0 and a + s.length <= len(data)
                        out["key"].append(k)
                        out["signature"].append(n)
                        out["start"].append(i * size + a)
                        out["proven"].append(hashlib.sha256(data[a : a + s.length]).hexdigest() == s.sha256 if inside else None)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("signature", pa.int32()), ("start", pa.int64()), ("proven", pa.bool_())]))

    return slices.mapInArrow(run, "key long, signature int, start long, proven boolean")


def _proofs(slices: DataFrame, open_: DataFrame, signatures: list[Signature], size: int) -> DataFrame:
    """(key, signature, start): open candidates whose range has the right digest, over the slices that it covers."""
    length = F.element_at(F.array(*(F.lit(s.length) for s in signatures)), F.col("signature") + 1)
    asked = open_.select("key", "signature", "start", (F.col("start") + length).alias("stop"))
    asked = asked.withColumn("idx", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    parts = asked.join(slices.select("key", "idx", "content"), ["key", "idx"])
    begin = F.greatest(F.col("start") - F.col("idx") * size, F.lit(0))
    stop = F.least(F.col("stop") - F.col("idx") * size, F.lit(size))
    parts = parts.select("key", "signature", "start", "idx", F.substring("content", begin.cast("int") + 1, (stop - begin).cast("int")).alias("part"))
    ordered = parts.repartition("key", "signature", "start").sortWithinPartitions("key", "signature", "start", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, held = None, None, 0
        done: list[tuple] = []

        def close() -> None:
            if now is not None and held == signatures[now[1]].length and digest.hexdigest() == signatures[now[1]].sha256:
                done.append(now)

        for b in batches:
            for *of, _, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(of) != now:
                    close()
                    now, digest, held = tuple(of), hashlib.sha256(), 0
                digest.update(part)
                held += len(part)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["key", "signature", "start"])

    return ordered.mapInArrow(run, "key long, signature int, start long")


def find_payloads(sources: DataFrame, slices: DataFrame, signatures: list[Signature], size: int = SLICE) -> DataFrame:
    """(key, candidates, error, matches) for each source (key, size): matches as sorted (start, stop), null where there is an error.

    Anchors are taken signature by signature, ascending. The 129th is an error (``candidates``), so is the 17th match
    (``matches``), whichever comes first, and so are matches that overlap. Counts stop at the first one past its limit.
    """
    signatures = checked(signatures)
    length = F.element_at(F.array(*(F.lit(s.length) for s in signatures)), F.col("signature") + 1)
    order = W.partitionBy("key").orderBy("signature", "start")
    found = _candidates(slices, signatures, size).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= MOST_CANDIDATES + 1)
    found = found.join(sources.select("key", "size"), "key").withColumn("fits", (F.col("start") >= 0) & (F.col("start") + length <= F.col("size")))
    proofs = _proofs(slices, found.where("proven IS NULL AND fits"), signatures, size).withColumn("proof", F.lit(True))
    found = found.join(proofs, ["key", "signature", "start"], "left").withColumn("match", F.coalesce("proven", "proof", F.lit(False)) & F.col("fits"))
    found = found.withColumn("matched", F.sum(F.col("match").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    span = F.when(F.col("match"), F.struct(F.col("start"), (F.col("start") + length).alias("stop")))
    per = found.groupBy("key").agg(
        F.max("nth").cast("long").alias("candidates"),
        F.min(F.when(F.col("matched") > MOST_MATCHES, F.col("nth"))).alias("many"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    touching = F.exists(F.sequence(F.lit(1), F.size("spans") - 1), lambda i: F.get("spans", i - 1)["stop"] > F.get("spans", i)["start"])
    overlap = F.when(F.size("spans") > 1, touching).otherwise(F.lit(False))
    error = F.when(F.col("many") <= MOST_CANDIDATES, "matches").when(F.col("candidates") > MOST_CANDIDATES, "candidates").when(overlap, "overlap")
    out = sources.select("key").join(per.withColumn("error", error), "key", "left")
    counted = F.least(F.coalesce("candidates", F.lit(0)), F.coalesce(F.when(F.col("error") == "matches", F.col("many")), F.lit(MOST_CANDIDATES + 1)))
    return out.select("key", counted.cast("long").alias("candidates"), "error", F.when(F.col("error").isNull(), F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))).alias("matches"))


def boundaries(packets: DataFrame, marks: DataFrame, block: int = SLICE) -> DataFrame:
    """Each mark (key, at) with ``cut``: whether a packet holds it inside, and the video packets that start there: ``n``, ``keyframe``, pts, dts.

    Packets: key, pos, size, video, keyframe, pts, dts. Marks and packets meet in blocks of positions, a packet in each block that it
    touches, and within a block in one ordered stream: a running maximum of the packets' ends tells whether one reaches
    over the mark. So the work is linear in packets, and a long source is many blocks.
    """
    last = F.floor((F.col("pos") + F.greatest("size", F.lit(1)) - 1) / block)
    spread = packets.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / block), last)))
    stream = spread.select("key", "block", F.col("pos").alias("t"), F.lit(1).alias("kind"), (F.col("pos") + F.col("size")).alias("stop"), "video", "keyframe", "pts", "dts")
    stream = stream.unionByName(marks.select("key", F.floor(F.col("at") / block).alias("block"), F.col("at").alias("t"), F.lit(0).alias("kind")).distinct(), allowMissingColumns=True)
    # a mark comes before the packets that start at it, so what is before it starts before it
    before = W.partitionBy("key", "block").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, -1)
    there = W.partitionBy("key", "block", "t")
    at = lambda c: F.max(F.when(F.col("video"), F.col(c))).over(there)
    merged = stream.withColumns({"cut": F.coalesce(F.max("stop").over(before) > F.col("t"), F.lit(False)), "n": F.count_if("video").over(there), "keys": F.coalesce(F.bool_and(F.when(F.col("video"), F.col("keyframe"))).over(there), F.lit(False)), "p": at("pts"), "d": at("dts")})
    return merged.where("kind = 0").select("key", F.col("t").alias("at"), "cut", "n", F.col("keys").alias("keyframe"), F.col("p").alias("pts"), F.col("d").alias("dts"))


def removals(packets: DataFrame, spans: DataFrame, sizes: DataFrame, block: int = SLICE) -> DataFrame:
    """Each span (key, start, stop) with the first rule that forbids removing it, or null, and the ``ticks`` that it takes.

    ``packet``: a packet of the source is out of the file (sizes: key, bytes), empty or without duration; ``order``: decode times of a
    stream do not ascend; ``cut``: a border cuts a packet; ``keyframe``: a border is not one video keyframe alone;
    ``time``: presentation or decode times do not ascend within the span, or it starts before the one before it ends.
    """
    per = packets.join(sizes, "key").withColumn("bad", (F.col("pos") < 0) | (F.col("pos") >= F.col("bytes")) | (F.col("size") <= 0) | (F.col("pos") + F.col("size") > F.col("bytes")) | (F.col("duration") <= 0))
    earlier = F.max("dts").over(W.partitionBy("key", "stream").orderBy("pos", "dts").rowsBetween(W.unboundedPreceding, -1))
    health = per.withColumn("back", F.coalesce(F.col("dts") <= earlier, F.lit(False))).groupBy("key").agg(F.bool_or("bad").alias("bad"), F.bool_or("back").alias("back"))
    marks = boundaries(packets, spans.select("key", F.col("start").alias("at")).union(spans.select("key", "stop")), block)
    side = lambda name, column: marks.select("key", F.col("at").alias(column), F.struct("cut", "n", "keyframe", "pts", "dts").alias(name))
    rows = spans.join(health, "key", "left").join(side("a", "start"), ["key", "start"], "left").join(side("z", "stop"), ["key", "stop"], "left")
    order = W.partitionBy("key").orderBy("start")
    late = F.coalesce((F.col("a.pts") < F.lag("z.pts").over(order)) | (F.col("a.dts") < F.lag("z.dts").over(order)), F.lit(False))
    alone = lambda c: (F.col(f"{c}.n") == 1) & F.col(f"{c}.keyframe")
    rule = F.when(F.coalesce("bad", F.lit(True)), "packet").when(F.col("back"), "order").when(F.col("a.cut") | F.col("z.cut"), "cut").when(~(alone("a") & alone("z")), "keyframe")
    rule = rule.when(late | (F.col("z.pts") <= F.col("a.pts")) | (F.col("z.dts") <= F.col("a.dts")), "time")
    rows = rows.withColumn("refused", rule)
    return rows.select("key", "start", "stop", "refused", F.when(F.col("refused").isNull(), F.col("z.pts") - F.col("a.pts")).alias("ticks"))
