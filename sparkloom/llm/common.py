"""Shared folders, staged tables and key ranges for the operators of this subpackage."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tuned

#: Rows in an Arrow batch. The default of 10,000 holds whole texts of any length in memory at once.
ARROW_ROWS = 1000


def session(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and set what results depend on; everything else is left as the cluster has set it."""
    tuned(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that no later step reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have, whatever the letter case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of ``docs`` with their own columns whose (doc_id, digest) is in ``verdicts``; ``once``: repeated rows once."""
    key, digest = fresh(docs, "key", "digest")
    rows = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
    good = verdicts.select(F.col("doc_id").alias("v_id"), F.col("digest").alias("v_digest")).distinct()
    rows = rows.join(good, rows[key].eqNullSafe(good.v_id) & (rows[digest] == good.v_digest), "left_semi")
    return (rows.dropDuplicates([key, digest]) if once else rows).drop(key, digest)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder URI; works on executors, where there is no JVM gateway."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def publish(fs: pafs.FileSystem, path: str, value: dict) -> None:
    """Write JSON under a temporary name, then rename it: readers see all of it or nothing."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f:
        f.write(json.dumps(value, sort_keys=True).encode())
    fs.move(temporary, path)


class Ranges:
    """Deterministic key ranges of about ``per_part`` rows, found by exact counting rather than by sampling.

    Part 0 starts with the null keys. A single key (or the nulls) with more rows than that is split over several
    parts by a tie value, so one hot key cannot overload a part; a bin of several keys never is. Only the counts and
    bounds of bins reach the driver: about ``BINS`` a round, or a few for each part where that is more.
    """

    BINS = 4096

    def __init__(self, edges: np.ndarray, base: np.ndarray, split: np.ndarray):
        self.edges, self.base, self.split = edges, base, split

    @property
    def parts(self) -> int:
        return int(self.base[-1] + self.split[-1])

    def of(self, keys: np.ndarray, null: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The part of each row; ``tie`` is any non-negative int64 that depends on the row alone."""
        bin_ = np.where(null, 0, np.searchsorted(self.edges, keys, "right"))
        return (self.base[bin_] + tie % self.split[bin_]).astype(np.int32)

    @classmethod
    def over(cls, df: DataFrame, key: str, per_part: int) -> Ranges:
        keys = df.select(F.col(key).cast("long").alias("k"))
        low, high = keys.agg(F.min("k"), F.max("k")).first()
        # edges[i] is the least key of bin i + 1; bin 0 holds nulls (keys below edges[0] do not exist)
        edges = np.array([0 if low is None else low], np.int64)
        if low is not None:
            width = max(1, -(-(high - low + 1) // cls.BINS))
            edges = np.array([low + i * width for i in range(-(-(high - low + 1) // width))], np.int64)
        # a round cuts the keys that a heavy bin really holds into several bins, each at most a half of them wide: that ends
        while True:
            found, least, most = cls._count(keys, edges)
            heavy = [i for i, n in enumerate(found) if i and n > per_part and least[i] < most[i]]
            if not heavy:
                break
            each = max(16, cls.BINS // len(heavy))
            more = [x for i in heavy for x in range(least[i], most[i] + 1, -(-(most[i] - least[i] + 1) // each))]
            # light neighbours are merged, so the number of bins stays bounded
            edges = np.unique(np.concatenate([edges[cls._keep(found[1:], per_part)], np.array(more, np.int64), edges[:1]]))
        # bins and counts belong together here, and a bin with more than per_part rows holds one key
        base, split, part, room = [], [], 0, 0
        for n in found:
            if n > per_part:
                part += bool(room)
                base.append(part)
                split.append(-(-n // per_part))
                part += split[-1]
                room = 0
            else:
                if room + n > per_part:
                    part, room = part + 1, 0
                base.append(part)
                split.append(1)
                room += max(n, 1)
        return cls(edges, np.array(base, np.int64), np.array(split, np.int64))

    @staticmethod
    def _keep(found: list[int], per_part: int) -> np.ndarray:
        keep, room = np.zeros(len(found), bool), per_part + 1
        for i, n in enumerate(found):
            if room + n > per_part or n > per_part:
                keep[i], room = True, 0
            room += n
        return keep

    @staticmethod
    def _count(keys: DataFrame, edges: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Rows, least key and greatest key of each bin."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(edges) + 1, np.int64)
            least, most = np.full(len(total), np.iinfo(np.int64).max), np.full(len(total), np.iinfo(np.int64).min)
            for b in batches:
                k = b.column(0)
                null = np.asarray(k.is_null())
                v = np.asarray(k.fill_null(0))
                at = np.where(null, 0, np.searchsorted(edges, v, "right"))
                total += np.bincount(at, minlength=len(total))
                np.minimum.at(least, at, v)
                np.maximum.at(most, at, v)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(least[at]), pa.array(most[at])], ["b", "n", "least", "most"])

        counted = keys.mapInArrow(partial, "b long, n long, least long, most long").groupBy("b")
        out, least, most = ([0] * (len(edges) + 1) for _ in range(3))
        for r in counted.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
            out[r.b], least[r.b], most[r.b] = int(r.n), r.least, r.most
        return out, least, most
