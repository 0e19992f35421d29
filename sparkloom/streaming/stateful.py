"""Event-time folds with timers: the same rules over a table and over a stream with late and unordered rows.

A ``Fold`` says what a row does to the state of its key, when the state runs out (``deadline``) and what happens then. Over a
table, rows stream through tasks in key and time order. Over a stream, rows wait in state until the watermark passes their time
and are taken in time order then, so unordered rows within the watermark change nothing; Spark drops rows behind it.
A deadline is met as soon as an event, or the watermark, is at it: both forms give the same rows up to the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from .folds import from_ddl


class Fold:
    """Rules of one key: rows are dicts with ``time`` in milliseconds, the state is a JSON value, results are dicts."""

    schema = ""

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, row: dict) -> list[dict]:
        """Change the state by a row."""
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        return None

    def expire(self, state: dict, now: int) -> list[dict]:
        """Change the state because its deadline ``now`` has come."""
        return []

    def until(self, state: dict, time: int) -> list[dict]:
        """All that runs out up to a time."""
        out = []
        while (due := self.deadline(state)) is not None and due <= time:
            out += self.expire(state, due)
        return out


def over_table(rows: DataFrame, key: str, time: str, order: list[str], fold: Fold, until: int | None = None) -> DataFrame:
    """The fold over a table. ``until``: the time in milliseconds up to which deadlines without a later row are met."""
    kinds = from_ddl(fold.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def close() -> list[dict]:
            return fold.until(state, until) if now is not None and until is not None else []

        def made(key_: object, out: list[dict]) -> list[dict]:
            return [{key: key_, **o} for o in out]

        for b in batches:
            out = []
            for row in b.to_pylist():
                if now != (row[key],):
                    out += made(now[0], close()) if now is not None else []
                    now, state = (row[key],), fold.start()
                out += made(row[key], fold.until(state, row["time"]) + fold.step(state, row))
            yield pa.RecordBatch.from_pylist(out, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist(made(now[0], close()), kinds)

    timed = rows.withColumn("time", F.unix_millis(F.col(time).cast("timestamp")))
    if time != "time":
        timed = timed.drop(time)
    return timed.repartition(key).sortWithinPartitions(key, "time", *order).mapInArrow(run, fold.schema)


class _Waiting(StatefulProcessor):
    """Rows wait for the watermark; timers stand at the earliest of them and at the state's deadline."""

    def __init__(self, key: str, order: list[str], fold: Fold, names: list[str]):
        self.key, self.order, self.fold, self.names = key, order, fold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType().add("v", StringType())
        self.handle = handle
        self.state = handle.getValueState("state", text)
        self.rows = handle.getListState("rows", text)

    def _settle(self, key: tuple, rows: list[dict], watermark: int) -> Iterator[Row]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()
        due = sorted((r for r in rows if r["time"] <= watermark), key=lambda r: (r["time"], *(r[c] for c in self.order)))
        wait = [r for r in rows if r["time"] > watermark]
        out = []
        for row in due:
            out += self.fold.until(state, row["time"]) + self.fold.step(state, row)
        out += self.fold.until(state, watermark)
        self.state.update((json.dumps(state),))
        self.rows.put([(json.dumps(r),) for r in wait]) if wait else self.rows.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due_next = self.fold.deadline(state)
        for t in {*([min(r["time"] for r in wait)] if wait else []), *([due_next] if due_next is not None else [])}:
            self.handle.registerTimer(t)
        for o in out:
            values = {self.key: key[0], **o}
            yield Row(**{n: values.get(n) for n in self.names})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [json.loads(r[0]) for r in self.rows.get()] if self.rows.exists() else []
        yield from self._settle(key, held + [{k: v for k, v in r.asDict().items() if k != "_at"} for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [json.loads(r[0]) for r in self.rows.get()] if self.rows.exists() else []
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())


def over_stream(rows: DataFrame, key: str, time: str, order: list[str], fold: Fold, delay: str) -> DataFrame:
    """The fold over a stream whose rows come up to ``delay`` late; needs the RocksDB state store."""
    timed = rows.withWatermark(time, delay).withColumn("time", F.unix_millis(F.col(time).cast("timestamp"))).withColumnRenamed(time, "_at")
    names = [c.split()[0] for c in fold.schema.split(", ")]
    return timed.groupBy(key).transformWithState(_Waiting(key, order, fold, names), fold.schema, "Append", "EventTime")


class Appends(Fold):
    """STM-06: fragments appended to one output, with a checkpoint of the last one and a rollback by one on restart.

    Rows: event_id, kind (``append`` or ``restart``), fragment, size, identity. An append counts if it is the next fragment and not
    empty; the checkpoint then holds its number and borders. A restart trusts the last append least: it goes back to
    that one's begin, and the checkpoint stays until another append has been made, so restarts repeat safely. It is refused,
    and all is kept, if the output belongs to another session (identity), is shorter than that begin or missing, or is there
    without a checkpoint.
    """

    schema = "user_id long, event_id long, result string, fragment long, start long, stop long"

    def __init__(self, fragments: int):
        self.fragments = fragments

    def start(self) -> dict:
        return {"saved": None, "fragment": None, "end": 0}

    def step(self, state: dict, row: dict) -> list[dict]:
        out = lambda result, fragment=None, start=None, stop=None: [{"event_id": row["event_id"], "result": result, "fragment": fragment, "start": start, "stop": stop}]
        saved = state["saved"]
        if row["kind"] == "restart":
            size = row["size"]
            if saved is None:
                if size:
                    return out("no_checkpoint")
                state |= {"saved": {"identity": row["identity"], "fragment": 0, "start": 0, "stop": 0}, "fragment": 0, "end": 0}
                return out("prepared", 0, 0, 0)
            if saved["identity"] != row["identity"]:
                return out("other_session")
            if (size or 0) < saved["start"] or saved["fragment"] > 0 and size is None:
                return out("shorter")
            state |= {"fragment": max(0, saved["fragment"] - 1), "end": saved["start"]}
            return out("prepared", state["fragment"], saved["start"], saved["start"])
        if state["fragment"] is None or row["fragment"] != state["fragment"] + 1 or not row["size"] or state["fragment"] >= self.fragments:
            return out("refused")
        start, stop = state["end"], state["end"] + row["size"]
        state |= {"saved": {"identity": saved["identity"], "fragment": row["fragment"], "start": start, "stop": stop}, "fragment": row["fragment"], "end": stop}
        return out("appended", row["fragment"], start, stop)


class Jobs(Fold):
    """STM-09, STM-13, STM-15: a queue of jobs with one worker, whose claims run out if nothing is heard of them.

    Rows: event_id, kind, task, attempt, text. ``enqueue`` follows the job's prior status: a new or cancelled one, a failed one, and
    a completed one with a blank text are queued (a failed one keeps its finished ``parts``, others start anew), one
    that is queued, running or completed with a text stays. ``claim`` takes the first queued job if none runs. ``beat``, ``finish`` and
    ``fail`` name the job and the attempt of their claim; of any other they are stale and change nothing. ``cancel`` ends a job that is
    queued or running. A running job of which nothing is heard for ``lease`` milliseconds is queued again, at its old place, and later news of that
    claim is stale. The state holds the queue's jobs.
    """

    schema = "user_id long, event_id long, action string, task long, attempt long, parts long"

    def __init__(self, lease: int):
        self.lease = lease

    def start(self) -> dict:
        return {"jobs": {}, "next": 0, "running": None, "heard": 0}

    def deadline(self, state: dict) -> int | None:
        return None if state["running"] is None else state["heard"] + self.lease

    def expire(self, state: dict, now: int) -> list[dict]:
        task, state["running"] = state["running"], None
        job = state["jobs"][task]
        job["status"] = "queued"
        return [{"event_id": None, "action": "expired", "task": int(task), "attempt": job["attempt"], "parts": job["parts"]}]

    def step(self, state: dict, row: dict) -> list[dict]:
        kind, task, jobs = row["kind"], str(row["task"]), state["jobs"]
        job = jobs.get(task)

        def out(action: str, job: dict, task: str = task) -> list[dict]:
            return [{"event_id": row["event_id"], "action": action, "task": int(task), "attempt": job["attempt"], "parts": job["parts"]}]

        if kind == "enqueue":
            if job is not None and (job["status"] in ("queued", "running") or job["status"] == "completed" and job["text"]):
                return []
            kept = job["parts"] if job is not None and job["status"] == "failed" else 0
            jobs[task] = {"status": "queued", "attempt": job["attempt"] if job else 0, "place": state["next"], "parts": kept, "text": False}
            state["next"] += 1
            return out("queued", jobs[task])
        if kind == "claim":
            queued = [(j["place"], t) for t, j in jobs.items() if j["status"] == "queued"]
            if state["running"] is not None or not queued:
                return []
            task = min(queued)[1]
            jobs[task] |= {"status": "running", "attempt": jobs[task]["attempt"] + 1}
            state |= {"running": task, "heard": row["time"]}
            return out("claimed", jobs[task], task)
        if kind == "cancel":
            if job is None or job["status"] not in ("queued", "running"):
                return []
            if job["status"] == "running":
                state["running"] = None
            job["status"] = "cancelled"
            return out("cancelled", job)
        if job is None or job["status"] != "running" or job["attempt"] != row["attempt"]:
            return []
        if kind == "beat":
            job["parts"] += 1
            state["heard"] = row["time"]
            return out("heard", job)
        state["running"] = None
        job |= {"status": "completed" if kind == "finish" else "failed", "text": bool(row["text"])}
        return out(job["status"], job)


def append_batches(stream: DataFrame, folder: str, checkpoint: str, after=None):
    """A stream's rows under ``folder``, a directory per micro-batch that a repeated batch writes anew: each row comes once.

    ``after``: called with the number of a batch between its rows and Spark's own commit.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        if after is not None:
            after(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_over_stream(reads: DataFrame, key: str, time: str, timeout: int, delay: str) -> DataFrame:
    """STM-13 over a stream: (key, first, last, reads) of each session once the watermark is past its end."""
    own = F.session_window(time, f"{timeout} seconds")
    return reads.withWatermark(time, delay).groupBy(key, own).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("reads")).drop("session_window")
