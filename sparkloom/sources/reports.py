"""Published tables: a data source that reads with pushed filters, and a writer whose result is seen whole or not at all.

A table is a folder of Parquet parts and ``current.json``, which names the parts of the generation that counts. Tasks write
parts under names of their own; only when all have ended is the pointer replaced, by one rename. A writer that fails leaves the
generation before it as it was, and parts that no pointer names are never read. Reading is pruned by the least and greatest
values of each part, and rows are filtered as they are read.
"""

from __future__ import annotations

import datetime
import decimal
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAME = "loom_table"
POINTER = "current.json"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    return fs, root.rstrip("/")


def _current(folder: str) -> dict | None:
    fs, root = _open(folder)
    if fs.get_file_info(f"{root}/{POINTER}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{POINTER}") as f:
        return json.loads(f.read())


def _plain(v: object) -> object:
    """A value as JSON keeps it exactly, or None: such a bound prunes nothing."""
    return v if isinstance(v, bool | int | str) or isinstance(v, float) and v == v else None


@dataclass
class _Written(D.WriterCommitMessage):
    name: str | None
    rows: int
    bounds: dict


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, replace: bool):
        self.folder, self.schema, self.replace = folder, schema, replace
        self.generation = uuid.uuid4().hex
        self._refuse()

    def _refuse(self) -> None:
        if not self.replace and _current(self.folder) is not None:
            raise FileExistsError(f"{self.folder} is published; replace it or choose another folder")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _open(self.folder)
        fs.create_dir(f"{root}/parts", recursive=True)
        name = f"parts/{self.generation}-{uuid.uuid4().hex}.parquet"
        out, rows, low, high = None, 0, {}, {}
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                out = out or pq.ParquetWriter(f"{root}/{name}", b.schema, filesystem=fs)
                out.write_batch(b)
                rows += b.num_rows
                for field, column in zip(b.schema, b.columns, strict=True):
                    if pa.types.is_integer(field.type) or pa.types.is_floating(field.type) or pa.types.is_string(field.type):
                        bound = pc.min_max(column).as_py()
                        for held, key, pick in ((low, "min", min), (high, "max", max)):
                            if bound[key] is not None:
                                held[field.name] = pick(held.get(field.name, bound[key]), bound[key])
        finally:
            if out is not None:
                out.close()
        return _Written(name if rows else None, rows, {c: [_plain(low[c]), _plain(high[c])] for c in low})

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.folder)
        self._refuse()
        parts = sorted(({"name": m.name, "rows": m.rows, "bounds": m.bounds} for m in messages if m is not None and m.name), key=lambda p: p["name"])
        fs.create_dir(root, recursive=True)
        made = f"{root}/{POINTER}.{self.generation}.tmp"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"schema": self.schema.json(), "parts": parts}, sort_keys=True).encode())
        fs.move(made, f"{root}/{POINTER}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _open(self.folder)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class _Part(D.InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(D.DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema, self.taken = folder, schema, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            inner = f.child if isinstance(f, D.Not) else f
            known = isinstance(inner, D.EqualTo | D.In | D.GreaterThan | D.GreaterThanOrEqual | D.LessThan | D.LessThanOrEqual | D.StringStartsWith | D.IsNotNull | D.IsNull)
            values = inner.value if isinstance(inner, D.In) else [getattr(inner, "value", 0)]
            exact = all(isinstance(v, bool | int | float | str | datetime.date | decimal.Decimal) for v in values)
            if known and exact and len(inner.attribute) == 1:
                self.taken.append(f)
            else:
                yield f

    def partitions(self) -> list[_Part]:
        found = _current(self.folder)
        return [_Part(p["name"]) for p in (found or {"parts": []})["parts"] if all(self._may_hold(f, p["bounds"]) for f in self.taken)]

    @staticmethod
    def _may_hold(f: D.Filter, bounds: dict) -> bool:
        if isinstance(f, D.Not | D.IsNull | D.IsNotNull) or (known := bounds.get(f.attribute[0])) is None or None in known:
            return True
        low, high = known
        if isinstance(f, D.StringStartsWith):
            return low[: len(f.value)] <= f.value <= high[: len(f.value)]
        if isinstance(f, D.In):
            return any(low <= v <= high for v in f.value)
        if isinstance(f, D.EqualTo):
            return low <= f.value <= high
        if isinstance(f, D.GreaterThan | D.GreaterThanOrEqual):
            return high > f.value or isinstance(f, D.GreaterThanOrEqual) and high == f.value
        return low < f.value or isinstance(f, D.LessThanOrEqual) and low == f.value

    @staticmethod
    def _expression(f: D.Filter) -> pc.Expression:
        if isinstance(f, D.Not):
            return ~_Reader._expression(f.child)
        c = pc.field(f.attribute[0])
        if isinstance(f, D.IsNull):
            return c.is_null()
        if isinstance(f, D.IsNotNull):
            return c.is_valid()
        if isinstance(f, D.StringStartsWith):
            return pc.starts_with(c, f.value)
        if isinstance(f, D.In):
            # of a null, neither this nor its negation holds
            return pc.if_else(c.is_valid(), c.isin(list(f.value)), pa.scalar(None, pa.bool_()))
        return {D.EqualTo: c == f.value, D.GreaterThan: c > f.value, D.GreaterThanOrEqual: c >= f.value, D.LessThan: c < f.value, D.LessThanOrEqual: c <= f.value}[type(f)]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no part to read
            return
        fs, root = _open(self.folder)
        rows = None
        for f in self.taken:
            rows = self._expression(f) if rows is None else rows & self._expression(f)
        table = ds.dataset(f"{root}/{partition.name}", filesystem=fs, format="parquet")
        yield from table.to_batches(columns=self.schema.fieldNames(), filter=rows, batch_size=4096)


class LoomTable(D.DataSource):
    """The data source ``loom_table``; its option ``path`` is the folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = _current(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"nothing is published in {self.options['path']}")
        return StructType.fromJson(json.loads(found["schema"]))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LoomTable)


def publish(df: DataFrame, folder: str, replace: bool = True) -> None:
    """SNK-03: publish a table in a folder; without ``replace`` a folder where one is published already is refused."""
    _ready(df.sparkSession)
    df.write.format(NAME).mode("overwrite" if replace else "append").option("path", folder).save()


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The table that is published in a folder; filters on it are pushed down to its parts."""
    _ready(spark)
    return spark.read.format(NAME).option("path", folder).load()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, or a temporary one where all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Columns of a review, in order (fixed values).
REVIEW = ("id", "S", "A", "P", "L", "C", "edge_overlay", "programme_negative", "raw_positive", "score", "decision", "action")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-24: the cases of report files, one object a file; a file without an array of objects ``cases`` fails the read."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("v"))
    cases = F.try_variant_get("v", "$.cases", "array<variant>")
    objects = cases.isNotNull() & F.forall(cases, lambda c: F.startswith(F.schema_of_variant(c), F.lit("OBJECT")))
    good = F.when(F.coalesce(objects, F.lit(False)), cases).otherwise(F.raise_error(F.lit("requires raw report object containing cases array")).cast("array<variant>"))
    rows = files.select(F.sha2("raw", 256).alias("source_input_sha256"), F.posexplode(good).alias("place", "c"))
    return rows.select("source_input_sha256", "place", F.from_json(F.to_json("c"), schema).alias("case"))


def write_report(cases: DataFrame, folder: str) -> None:
    """SNK-01: a report's cases as JSON lines in ``report`` and its review as CSV in ``review``; a folder that exists is refused."""
    cases.write.mode("errorifexists").json(f"{folder}/report")
    cases.select(*REVIEW).write.mode("errorifexists").option("header", True).csv(f"{folder}/review")
