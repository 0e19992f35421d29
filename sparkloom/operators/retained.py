"""Validation of kept media, and when the decode made during its download stands for a new one.

A receipt says that a download was decoded in full, and binds this to what was decoded: digests over the packets of each stream in
order, and over the video's times. It holds for a file only while the session, the tool and all digests are those of the file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of a fingerprint (fixed values), and the tolerances of durations in seconds.
KINDS = ("video", "audio", "video_timing")
MANIFEST_SLACK, MEDIA_SLACK = 1e-6, 1.0
_HEX = "^[0-9a-f]{64}$"


def fingerprints(packets: DataFrame) -> DataFrame:
    """(key, prints): map of kind to struct<amount, sha256> over packets (key, kind, position, size, digest, pts, dts).

    The streams' bytes are told by the digests of their packets in order, the video's timing by its times relative to its first.
    Each digest is made over sorted rows, so the size of a file does not matter.
    """
    first = W.partitionBy("key", "kind")
    # all windows and digests of a file ask for its packets by key and in this order, so they share one shuffle and one sort
    rows = packets.repartition("key").sortWithinPartitions("key", "kind", "position")
    rows = rows.withColumns({"p": F.col("pts") - F.min("pts").over(first), "d": F.col("dts") - F.min("dts").over(first)})
    rows = rows.select("key", "kind", "position", F.col("size").cast("int").alias("size"), F.coalesce("digest", F.lit("")).alias("digest"), F.when(F.col("kind") == "video", F.concat_ws(",", "p", "d")).alias("time"))
    key = dict(rows.dtypes)["key"]
    fields = pa.map_(pa.string(), pa.struct([("amount", pa.int64()), ("sha256", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packets arrive by key, kind and position: it holds the digests of one file."""
        now, made = None, {}
        close = lambda: sorted((k, {"amount": a, "sha256": h.hexdigest()}) for k, (a, h) in made.items())
        batch = lambda keys, prints: pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(prints, fields)], names=["key", "prints"])
        for b in batches:
            keys, prints, kind = [], [], b.schema.field(0).type
            for k, stream, size, digest, time in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if now != (k,):
                    if now is not None:
                        keys.append(now[0])
                        prints.append(close())
                    now, made = (k,), {}
                for name, amount, value in ((stream, size, digest), ("video_timing", 1, time)):
                    if value is not None:
                        held = made.setdefault(name, [None, hashlib.sha256()])
                        held[0] = held[0] if amount is None else amount + (held[0] or 0)
                        held[1].update(value.encode() + b"\n")
            yield batch(keys, prints)
        if now is not None:
            yield batch([now[0]], [close()])

    return rows.sortWithinPartitions("key", "kind", "position").mapInArrow(run, f"key {key}, prints map<string, struct<amount: bigint, sha256: string>>")


def fingerprints_valid(prints: Column) -> Column:
    """Whether there is one well-formed fingerprint of each kind and nothing else."""
    each = [F.coalesce((F.try_element_at(prints, F.lit(k))["amount"] > 0) & F.rlike(F.try_element_at(prints, F.lit(k))["sha256"], F.lit(_HEX)), F.lit(False)) for k in KINDS]
    return F.coalesce(F.size(prints) == len(KINDS), F.lit(False)) & each[0] & each[1] & each[2]


def reuse_reason(session: Column, receipt: Column, expected: Column, audio: Column, tool: Column, prints: Column) -> Column:
    """Why a receipt does not stand for a decode of the file, or ``complete_decode_and_encoded_content_match``.

    session: struct<schema, mode, token, identity, durations>; receipt: struct<schema, status, identity, token, mode, eof, full_decode, segments,
    source_bytes, source_sha256, tool, prints>; audio: struct<profile, channels> of the file; prints: the file's own.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    total = F.aggregate(session["durations"], F.lit(0.0), lambda s, x: s + x)
    stale = no((session["schema"] == 1) & (session["mode"] == "video") & (session["token"] != "") & (receipt["schema"] == 1) & (receipt["status"] == "valid") & (receipt["identity"] == session["identity"]))
    stale |= no((receipt["token"] == session["token"]) & (receipt["mode"] == "video") & receipt["eof"] & receipt["full_decode"] & (F.size(session["durations"]) > 0) & (F.abs(total - expected) <= MANIFEST_SLACK))
    stale |= no((receipt["segments"] == F.size(session["durations"])) & (receipt["source_bytes"] > 0) & F.rlike(receipt["source_sha256"], F.lit(_HEX)))
    same = [F.coalesce(F.try_element_at(receipt["prints"], F.lit(k)).eqNullSafe(F.try_element_at(prints, F.lit(k))), F.lit(False)) for k in KINDS]
    return (
        F.when(session.isNull(), "not_enabled")
        .when(receipt.isNull(), "receipt_unavailable")
        .when(stale, "incomplete_or_stale_receipt")
        .when(no((audio["profile"] == "LC") & audio["channels"].isin(1, 2)), "unsupported_audio_configuration")
        .when(no(receipt["tool"] == tool), "validator_or_engine_changed")
        .when(~fingerprints_valid(receipt["prints"]), "invalid_fingerprints")
        .when(~(same[0] & same[1] & same[2]), "encoded_content_mismatch_or_unavailable")
        .otherwise("complete_decode_and_encoded_content_match")
    )


def validated(files: DataFrame, packets: DataFrame) -> DataFrame:
    """SC-16, (key, status, reason, method, receipt) of files (key, expected, actual, codecs, session, receipt, audio, tool, decodes, changed).

    A file is valid if it has one H.264 and one AAC stream, the expected length within a second, decode times that ascend in each
    stream, a decode that holds, and is still what it was when all this began. ``method`` tells which decode: the one
    made ``during_download``, where its receipt stands for the file, or one made now (``decodes``: whether that succeeded).
    Fingerprints are made of the packets, unless the files have them as ``prints`` already.
    """
    earlier = F.max("dts").over(W.partitionBy("key", "kind").orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    health = packets.withColumn("back", F.coalesce(F.col("dts") <= earlier, F.lit(False))).groupBy("key").agg(F.bool_or("back").alias("back"), F.count_distinct("kind").alias("streams"))
    rows = files.join(health, "key", "left")
    if "prints" not in files.columns:
        rows = rows.join(fingerprints(packets), "key", "left")
    rows = rows.withColumn("why", reuse_reason(F.col("session"), F.col("receipt"), F.col("expected"), F.col("audio"), F.col("tool"), F.col("prints")))
    reused = F.col("why") == "complete_decode_and_encoded_content_match"
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = F.when(no(F.array_sort("codecs") == F.array(F.lit("aac"), F.lit("h264"))), "requires_requested_streams:aac,h264").when(no(F.abs(F.col("actual") - F.col("expected")) <= MEDIA_SLACK), "retained_duration_mismatch")
    reason = reason.when(F.col("back"), "non_monotonic_retained_packet_dts").when(no(F.col("streams") == 2), "retained_packet_probe_failed")
    early = reason
    reason = reason.when(~reused & no(F.col("decodes")), "retained_full_av_decode_failed").when(F.col("changed"), "retained_media_changed_during_validation")
    probed = early.isNull()
    return rows.select("key", F.when(reason.isNull(), "valid").otherwise("unknown").alias("status"), reason.alias("reason"), F.when(probed, F.when(reused, "during_download").otherwise("after_download")).alias("method"), F.when(probed, F.col("why")).alias("receipt"))
