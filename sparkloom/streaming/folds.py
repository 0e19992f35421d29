"""Ordered folds: the same step function over a batch and inside a stateful stream.

A fold's state belongs to one key. In batch, a key's rows are folded in event order in one sorted pass; in a stream, each
micro-batch continues from the stored state, so both give the same rows for the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

Step = Callable[[tuple, dict], tuple[tuple, dict | None]]

#: Limits of a micro-batch: bytes, segments and seconds since the last flush (fixed values).
FLUSH_BYTES, FLUSH_SEGMENTS, FLUSH_SECONDS = 8 << 20, 12, 30.0


def from_ddl(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    return to_arrow_schema(StructType.fromDDL(schema))


def fold_batch(df: DataFrame, key: str, order: list[str], step: Step, start: tuple, schema: str) -> DataFrame:
    """Apply a step to each key's rows in order; ``schema`` is that of the key and the emitted rows.

    Rows stream through a task in key order: it holds one state, however many rows a key has.
    """
    kinds = from_ddl(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for b in batches:
            out = []
            for row in b.to_pylist():
                if now != (row[key],):
                    now, state = (row[key],), start
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def fold_stream(df: DataFrame, key: str, order: list[str], step: Step, start: tuple, state_schema: str, schema: str) -> DataFrame:
    """The same fold over a stream; rows of one micro-batch are ordered, later ones continue."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else start
        out = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
            now, made = step(now, row)
            if made is not None:
                out.append(made)
        state.update(now)
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def flush_step(key: str, id_: str, size: str, seconds: str) -> tuple[Step, tuple, str, str]:
    """Micro-batches that close at 8 MiB, 12 segments or 30 seconds: (step, start, state schema, output schema)."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict | None]:
        number, n, bytes_, time = state
        n, bytes_, time = n + 1, bytes_ + int(row[size]), time + float(row[seconds])
        if bytes_ >= FLUSH_BYTES or n >= FLUSH_SEGMENTS or time >= FLUSH_SECONDS:
            return (number + 1, 0, 0, 0.0), {key: row[key], "batch": number, "last_id": row[id_], "segments": n, "bytes": bytes_, "seconds": time}
        return (number, n, bytes_, time), None

    return step, (0, 0, 0, 0.0), "number long, n long, bytes long, seconds double", f"{key} long, batch long, last_id long, segments long, bytes long, seconds double"


#: Stages that a progress report or an older stage line may name (fixed values).
STAGES = ("source", "scan", "probe", "ocr", "restoring", "remux", "validate", "complete")


def progress_reports(events: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Accepted progress reports of each key with what has accumulated: done, of, unsure, ads, seconds, stage.

    Columns read: kind (report, legacy or tick), stage, completed, total, unknown, ads, elapsed. A report whose stage is none of
    ``STAGES`` or whose numbers contradict each other, and any legacy line once a report was accepted, changes nothing and
    gives no row. A legacy line without a count names a stage and sets that alone; one with a count sets the counts alone.
    Counts never go back: a total is at least what was done when it was told, an unsure count at most that; the last count of
    ads holds. Time runs from a key's first event until a report's stage is complete; a told time moves it forward only. A tick is a
    row of its own and tells time alone.
    """
    number = lambda c: F.when(F.col(c) >= 0, F.col(c))
    done, total, unknown = number("completed"), number("total"), number("unknown")
    staged = F.coalesce(F.col("stage").isin(*STAGES), F.lit(False))
    report = (F.col("kind") == "report") & staged & ~F.coalesce(done > total, F.lit(False)) & ~F.coalesce(unknown > done, F.lit(False))
    legacy = (F.col("kind") == "legacy") & F.when(F.col("completed").isNull(), staged).otherwise(F.coalesce(done <= total, F.lit(False)))
    all_ = W.partitionBy(key).orderBy(order)
    before, until = all_.rowsBetween(W.unboundedPreceding, -1), all_.rowsBetween(W.unboundedPreceding, 0)
    seen = F.coalesce(F.max(report).over(before), F.lit(False))
    rows = events.withColumns({"_report": F.coalesce(report, F.lit(False)), "_seen": seen, "_begin": F.min(time).over(W.partitionBy(key))})
    rows = rows.where(F.col("_report") | (legacy & ~F.col("_seen")) | (F.col("kind") == "tick"))
    counts = F.when(F.col("_report") | ((F.col("kind") == "legacy") & F.col("completed").isNotNull()), F.lit(True))
    named = F.when(F.col("_report") | ((F.col("kind") == "legacy") & F.col("completed").isNull()), F.col("stage"))
    rows = rows.withColumn("done", F.coalesce(F.max(F.when(counts, done)).over(until), F.lit(0)))
    rows = rows.withColumns(
        {
            "of": F.max(F.when(counts & total.isNotNull(), F.greatest(total, F.col("done")))).over(until),
            "unsure": F.max(F.when(F.col("_report"), F.when(unknown.isNotNull(), F.least(unknown, F.col("done"))))).over(until),
            "ads": F.last(F.when(F.col("_report"), number("ads")), ignorenulls=True).over(until),
            "stage": F.coalesce(F.last(named, ignorenulls=True).over(until), F.lit("source")),
            "_end": F.coalesce(F.last(F.when(F.col("_report"), F.col("stage") == "complete"), ignorenulls=True).over(until), F.lit(False)),
        }
    )
    stopped = F.coalesce(F.lag("_end").over(all_), F.lit(False))
    step = F.when(stopped, F.lit(0.0)).otherwise(F.greatest(F.col(time) - F.coalesce(F.lag(time).over(all_), F.col("_begin")), F.lit(0.0)))
    rows = rows.withColumn("_step", step).withColumn("_ran", F.sum("_step").over(until))
    lead = F.max(F.when(F.col("_report") & (F.col("elapsed") >= 0), F.col("elapsed") - F.col("_ran"))).over(until)
    return rows.withColumn("seconds", F.col("_ran") + F.greatest(F.coalesce(lead, F.lit(0.0)), F.lit(0.0))).drop("_report", "_seen", "_begin", "_end", "_step", "_ran")


def progress_summary(done: Column, of: Column, unsure: Column, ads: Column, seconds: Column, complete: Column) -> Column:
    """One line: what was handled, what is unsure, what was found, the time, and whether something stays."""
    known = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    s = F.floor(seconds).cast("long")
    minutes = F.concat((F.floor(s / 60) % 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    time = F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(minutes, 5, "0"))).otherwise(minutes)
    stays = F.coalesce(unsure > 0, F.lit(False)) | (complete & (of.isNull() | unsure.isNull()))
    return F.concat(done.cast("string"), F.lit("/"), known(of, "?"), F.lit(" unsure "), known(unsure, "?"), F.lit(" ads "), known(ads, "?"), F.lit(" "), time, F.when(stays, F.lit(" partial")).otherwise(F.lit("")))


def idle_sessions(reads: DataFrame, key: str, time: str, timeout: int) -> DataFrame:
    """(key, session, first, last, reads): a session ends when ``timeout`` seconds pass without a read."""
    order = W.partitionBy(key).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    gap = seconds - F.lag(seconds).over(order)
    begins = F.when(gap < timeout * 1_000_000, 0).otherwise(1)
    numbered = reads.withColumn("begins", begins).withColumn("session", F.sum("begins").over(W.partitionBy(key).orderBy(time).rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("reads"))
