"""Operator 6: a deterministic, sharded WARC writer and its reader.

Payloads with equal SHA-256 digests and at least ``least`` bytes are stored once: the record with the smallest page id is
the response, the others are revisits that refer to it. Records are dealt over exact key ranges (``Ranges``) and sorted by
page id, so the same table gives the same files, byte for byte. Each record is a gzip member of its own (no time stamp
inside); headers, ids, lengths and digests are made anew from the content. A file is closed once its compressed size
reaches ``roll``, and starts with a warcinfo record. ``date`` is the WARC-Date of every record, as pages carry none. Tasks write under temporary names; the driver renames what succeeded and publishes a manifest with every
file's size, digest and records last. Files of lost attempts are in no manifest and are removed.

Defined cases: a null payload is empty; a null URL is an empty target; a null page id sorts first and is never
referred to while a page with an id has that payload; rows that repeat an id are records of their own, the first by URL
being the response, and of equal rows one; an empty table gives a manifest without files; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SPACE = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")
REPORT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """A row per page, and a note for each (page, url) whose payload others share; only pages carry payloads.

    A note names the record that a shared payload belongs to. Notes sort before the pages they are about, so payloads
    travel once, straight to their place in the archive.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("size") >= least).groupBy("digest", "page", "url").agg(F.count("*").alias("n"))
    first = shared.groupBy("digest").agg(F.min(F.struct(F.col("page").isNull(), "page", "url")).alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    notes = shared.join(first, "digest").select("page", "url", F.lit(None).cast("string").alias("payload"), "digest", F.lit(-1).cast("long").alias("size"), F.col("first.page").alias("refers"), F.col("first.url").alias("refers_url"))
    return rows.withColumns({"refers": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}).unionByName(notes)


def record_id(page: int | None, url: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}|{url}|{kind}')}>"


def encode_record(page, url, payload, digest, size, kind, refers, refers_url, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    payload = (payload or "").encode()
    label = "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    clean = lambda x: x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page, url, kind)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: {label}",
        "WARC-Block-Digest: sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("="),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {size}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers, refers_url, 'response')}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}"]
        if refers is not None:
            head.append(f"X-Refers-To-Page-ID: {refers}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def encode_info(part: int, number: int, date: str) -> bytes:
    """The record that a file starts with: what it is and what wrote it."""
    block = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, f'file {part} {number}')}>",
        f"WARC-Date: {date}",
        "WARC-Block-Digest: sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("="),
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, roll: int = 128 << 20, pages_per_part: int = 8192, date: str = "2000-01-01T00:00:00Z") -> dict:
    """Write an archive at ``folder`` and return its manifest."""
    common.session(pages.sparkSession)
    ranges = common.Ranges.over(pages, id_col, pages_per_part)
    rows = records(pages, id_col, url_col, payload_col, least)

    @F.arrow_udf("int")
    def part(page: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(ranges.of(np.asarray(page.fill_null(0)), np.asarray(page.is_null()), np.asarray(tie)))

    # payloads stay in the JVM until they are written
    dealt = rows.select(part("page", F.crc32(F.col("url").cast("binary"))).alias("part"), "*")
    dealt = dealt.repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("page"), "url", "digest", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        out: _File | None = None
        note, about = None, None
        for b in batches:
            for part, page, url, payload, digest, size, refers, refers_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size < 0:
                    # the record that it names is a response once; equal rows after it are revisits of that one
                    note, about = (refers, refers_url), (page, url, digest)
                    again = note != (page, url)
                    continue
                if out is not None and (out.part != part or out.size >= roll):
                    yield out.close()
                    out = _File(fs, root, part, out.number + 1 if out.part == part else 0, date)
                if out is None:
                    out = _File(fs, root, part, 0, date)
                revisit = about == (page, url, digest) and again
                again = True
                out.add(encode_record(page, url, "" if revisit else payload, digest, size, "revisit" if revisit else "response", *(note if revisit else (None, None)), date))
        if out is not None:
            yield out.close()

    done = dealt.mapInArrow(run, "part int, number int, name string, records long, bytes long, sha256 string").collect()
    fs, root = common.filesystem(folder)
    fs.create_dir(root, recursive=True)
    files = []
    for r in sorted(done, key=lambda r: (r.part, r.number)):
        name = f"part-{r.part:06d}-{r.number:04d}.warc.gz"
        fs.move(f"{root}/_attempts/{r.name}", f"{root}/{name}")
        files.append({"name": name, "records": r.records, "bytes": r.bytes, "sha256": r.sha256})
    if done:
        fs.delete_dir(f"{root}/_attempts")
    manifest = {"format": "WARC/1.1", "records": sum(f["records"] for f in files), "files": files}
    common.publish(fs, f"{root}/manifest.json", manifest)
    return manifest


class _File:
    def __init__(self, fs, root: str, part: int, number: int, date: str):
        self.part, self.number, self.size, self.records = part, number, 0, 0
        self.name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz.tmp"
        self.file, self.sha = fs.open_output_stream(f"{root}/_attempts/{self.name}", compression=None), hashlib.sha256()
        self._put(encode_info(part, number, date))

    def _put(self, member: bytes) -> None:
        self.file.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, member: bytes) -> None:
        self._put(member)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.file.close()
        values = [[self.part], [self.number], [self.name], [self.records], [self.size], [self.sha.hexdigest()]]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["part", "number", "name", "records", "bytes", "sha256"])


def members(file) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, holding one member at a time."""
    offset, left = 0, b""
    while True:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            left = left or file.read(1 << 18)
            if not left:
                if parts or used:
                    raise ValueError(f"the record at {offset} is cut short")
                return
            parts.append(unpack.decompress(left))
            used += len(left) - len(unpack.unused_data)
            left = unpack.unused_data
        yield offset, b"".join(parts)
        offset += used


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; lengths and the block digest must be right."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("="):
        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    return headers, block


def read(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """A row per record (``REPORT``), from the archive's files."""
    names = [(f["name"],) for f in manifest["files"]]
    table = spark.createDataFrame(names, "name string").repartition(max(1, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.filesystem(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in REPORT.split(", ")])

        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for offset, raw in members(file):
                        h, block = decode_record(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        kind = h["WARC-Type"]
                        label = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        digest = base64.b32decode(label + "=" * (-len(label) % 8)).hex()
                        size = int(h["X-Payload-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{h['WARC-Record-ID']}: its payload is not what its headers say")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        rows.append((number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID"), name, offset))
                        if len(rows) == 2000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return table.mapInArrow(run, REPORT)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a new archive in the shared folder and report what its files hold."""
    folder = common.scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, folder, write(pages, folder, **options))
