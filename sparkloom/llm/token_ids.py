"""Operator 1: token ids as flat binary files with 64-bit document offsets.

A data set is a folder of shards and a ``manifest.json`` that is published last. Shard ``k`` has ``shard-k.bin``, the ids
of its documents one after the other as little-endian unsigned integers (16 bits where the vocabulary fits, else 32), and
``shard-k.idx``: a magic string, the number of documents n, n + 1 offsets counted in ids within the shard (unsigned 64
bits), n document ids (signed 64 bits) and n null flags. The manifest holds each shard's size and its base, the number
of ids in all shards before it: the prefix sum over shards. A reader maps the files into memory; nothing is parsed.

Documents are dealt over key ranges (``Ranges``), so shards and documents ascend by id and no task holds more than its
share. Only ids are shuffled, not texts. A task writes under a name of its own and reports it with its result, so lost
or doubled attempts leave files that no manifest names.

Defined cases: a null text is an empty one; an empty text has the end id alone; a null id sorts first; rows with
equal ids stay separate documents, ordered by a hash of their ids; an empty table gives no shard; only the id and the
text column are read, whatever else the table has.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import kernels as K
from .encoder import encoder

MAGIC = b"LOOMIDX1"
ENCODED = "part int, tie long, id long, n long, ids binary"
REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def encode(docs: DataFrame, tokenizer: str, ranges: common.Ranges, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Each document's ids with the end id, and the part that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            key = b.column(0)
            keys, null = np.asarray(key.fill_null(0)), np.asarray(key.is_null())
            for first, data, bounds, _ in K.blocks(b.column(1)):
                ids, at = enc.encode(data, bounds)
                raw, step = ids.tobytes(), ids.itemsize
                out = [raw[a * step : z * step] + end for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                tie = np.array([zlib.crc32(x) for x in out], np.int64)
                rows = slice(first, first + len(out))
                part = ranges.of(keys[rows], null[rows], tie)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(tie), key[rows], pa.array(np.diff(at) + 1), pa.array(out, pa.binary())], names=["part", "tie", "id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, docs_per_shard: int = 16384) -> dict:
    """Encode documents into a data set at ``folder`` and return its manifest."""
    common.session(docs.sparkSession)
    ranges = common.Ranges.over(docs, id_col, docs_per_shard)
    encoded = encode(docs, tokenizer, ranges, id_col, text_col, end_id)
    sorted_ = encoded.repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("id"), "tie", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        out = None
        for b in batches:
            part = np.asarray(b.column(0))
            for p in np.unique(part).tolist():
                a, z = np.searchsorted(part, [p, p + 1]).tolist()
                if out is None or out.part != p:
                    if out is not None:
                        yield out.close()
                    out = _Shard(fs, root, p)
                out.add(b.slice(a, z - a))
        if out is not None:
            yield out.close()

    done = sorted_.mapInArrow(run, "part int, name string, docs long, tokens long").collect()
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    width = encoder(tokenizer).dtype.itemsize
    shards, base = [], 0
    for k, r in enumerate(sorted(done, key=lambda r: r.part)):
        name = f"shard-{k:06d}"
        for kind in ("bin", "idx"):
            fs.move(f"{root}/_attempts/{r.name}.{kind}", f"{root}/{name}.{kind}")
        shards.append({"name": name, "docs": r.docs, "tokens": r.tokens, "base": base})
        base += r.tokens
    if done:
        fs.delete_dir(f"{root}/_attempts")
    manifest = {"format": 1, "width": width, "end_id": end_id, "tokens": base, "shards": shards}
    common.publish(fs, f"{root}/manifest.json", manifest)
    return manifest


class _Shard:
    def __init__(self, fs, root: str, part: int):
        self.fs, self.root, self.part = fs, root, part
        self.name = f"{part:06d}-{uuid.uuid4().hex}"
        self.file = fs.open_output_stream(f"{root}/_attempts/{self.name}.bin")
        self.sizes, self.ids, self.nulls = [], [], []

    def add(self, b: pa.RecordBatch) -> None:
        ids = b.column(4)
        at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        self.file.write(memoryview(ids.buffers()[2])[at[0] : at[-1]])
        self.sizes.append(np.asarray(b.column(3)))
        self.ids.append(np.asarray(b.column(2).fill_null(0)))
        self.nulls.append(np.asarray(b.column(2).is_null()).astype(np.uint8))

    def close(self) -> pa.RecordBatch:
        self.file.close()
        sizes = np.concatenate(self.sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        with self.fs.open_output_stream(f"{self.root}/_attempts/{self.name}.idx") as f:
            f.write(MAGIC + struct.pack("<Q", len(sizes)))
            f.write(offsets.tobytes())
            f.write(np.concatenate(self.ids).astype("<i8").tobytes())
            f.write(np.concatenate(self.nulls).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([self.part], pa.int32()), pa.array([self.name]), pa.array([len(sizes)]), pa.array([int(offsets[-1])])], names=["part", "name", "docs", "tokens"])


class Shard:
    """One shard, mapped into memory where its file system allows that."""

    def __init__(self, folder: str, name: str, width: int):
        fs, root = common.filesystem(folder)
        whole = lambda p: fs.open_input_file(p).read_buffer() if not isinstance(fs, pa.fs.LocalFileSystem) else pa.memory_map(p).read_buffer()
        idx = whole(f"{root}/{name}.idx")
        if bytes(idx[:8]) != MAGIC:
            raise ValueError(f"{name}.idx is not an offsets file")
        n = struct.unpack_from("<Q", idx, 8)[0]
        self.offsets = np.frombuffer(idx, "<u8", n + 1, 16).astype(np.int64)
        self.ids = np.frombuffer(idx, "<i8", n, 24 + 8 * n)
        self.nulls = np.frombuffer(idx, np.uint8, n, 24 + 16 * n).astype(bool)
        self.tokens = np.frombuffer(whole(f"{root}/{name}.bin"), f"<u{width}") if self.offsets[-1] else np.zeros(0, f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def read(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """A row per document of a data set, computed from its files: id, global start, number of ids and their CRC-32."""
    shards = [(k, s["name"], s["base"]) for k, s in enumerate(manifest["shards"])]
    table = spark.createDataFrame(shards, "k int, name string, base long")
    width = manifest["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, name, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shard(folder, name, width)
                for lo in range(0, len(s.ids), 4096):
                    hi = min(len(s.ids), lo + 4096)
                    crc = np.array([zlib.crc32(s.document(i).astype("<u4").data) for i in range(lo, hi)], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.ids[lo:hi], mask=s.nulls[lo:hi]), pa.array(base + s.offsets[lo:hi]), pa.array(np.diff(s.offsets[lo : hi + 1])), pa.array(crc), pa.array(np.full(hi - lo, k, np.int32))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    return table.repartition(max(1, len(shards))).mapInArrow(run, REPORT)


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write documents to a new data set in the shared folder and report what its files hold."""
    folder = common.scratch(docs.sparkSession, "token-ids")
    return read(docs.sparkSession, folder, write(docs, folder, tokenizer, **options))
