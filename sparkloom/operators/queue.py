"""Work queue and history rules over tables of tasks and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Task states (fixed values).
ACTIVE = ("EXTRACTING", "DOWNLOADING", "PROCESSING")
TERMINAL = ("COMPLETED", "FAILED", "CANCELED", "PREVIEW")
#: Pause kinds, weakest first (fixed values).
PAUSES = ("NETWORK", "SYSTEM", "STORAGE")
#: Delays before each retry of a transient failure, in seconds (fixed values).
DELAYS = (5, 15, 30, 60)


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def latest(writes: DataFrame, key: str, order: list[str], most: int, by: str | None = None) -> DataFrame:
    """The last write of each key, newest first, ``most`` of them (per ``by`` if given): adds ``rank`` from 1.

    Only the top rows per ``by`` are ranked: a window with a row limit keeps that many in each task before it shuffles.
    """
    last = writes.groupBy(*([by] if by else []), key).agg(F.max_by(F.struct(*[c for c in writes.columns if c not in (by, key)]), F.struct(*order)).alias("w")).select(*([by] if by else []), key, "w.*")
    w = W.partitionBy(*([by] if by else [])).orderBy(*(F.desc(c) for c in order))
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def claim(tasks: DataFrame, queue: str) -> DataFrame:
    """(queue, claimed, attempt): the first queued task of each queue that has nothing active and no pause."""
    busy = F.coalesce(F.bool_or(is_active(F.col("status")) | F.col("pause").isNotNull()), F.lit(False))
    first = F.min(F.when(F.col("status") == "QUEUED", F.struct("position", "id", "attempt")))
    return tasks.groupBy(queue).agg(first.alias("t"), busy.alias("busy")).where("NOT busy AND t IS NOT NULL").select(queue, F.col("t.id").alias("claimed"), (F.col("t.attempt") + 1).alias("attempt"))


def reorder(tasks: DataFrame, queue: str, target: Column) -> DataFrame:
    """New positions above all old ones: the target first, then active tasks, then the others as they were."""
    class_ = F.when(target, 0).when(is_active(F.col("status")), 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy(queue).orderBy("class", "position"))
    return tasks.withColumn("class", class_).withColumn("new_position", rank + F.max("position").over(W.partitionBy(queue)))


def deduplicate(existing: DataFrame, batch: DataFrame, key: list[str], id_: str, order: str) -> DataFrame:
    """(id, resolved): each batch row resolves to the open task, or the earlier batch row, with its key, else to itself."""
    both = existing.where(~is_terminal(F.col("status"))).select(*key, id_, F.lit(0).alias("wave"), F.col(order).alias("o")).unionByName(batch.select(*key, id_, F.lit(1).alias("wave"), F.col(order).alias("o")))
    first = F.first(id_).over(W.partitionBy(*key).orderBy("wave", "o", id_).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.withColumn("resolved", first).where("wave = 1").select(id_, "resolved")


def effective_pause(pause: Column) -> Column:
    """The strongest pause of a group, or null."""
    rank = F.array_position(F.array(*map(F.lit, PAUSES)), pause)
    return F.max_by(pause, F.when(pause.isNotNull(), rank))


def recovered(status: Column, interruption: Column) -> Column:
    """The state of a task after a crash."""
    return F.when(interruption == "DELETE", "DELETED").when(interruption == "CANCEL", "CANCELED").when(interruption == "PAUSE", "PAUSED").when(is_active(status), "QUEUED").otherwise(status)


def retry_delay(failures: Column) -> Column:
    """Seconds to wait before the next attempt after a number of transient failures; null if there is none."""
    return F.get(F.array(*map(F.lit, DELAYS)), (failures - 1).cast("int"))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, op): what a transaction has to write to turn one snapshot into the other."""
    both = old.select(key, F.col(value).alias("a"), F.lit(True).alias("was")).join(new.select(key, F.col(value).alias("b"), F.lit(True).alias("is")), key, "full_outer")
    op = F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull(), "insert").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.withColumn("op", op).where("op IS NOT NULL").select(key, "op")


def selection_toggle(selected: Column, available: Column, item: Column) -> Column:
    """The selection within what is available, with one item switched."""
    kept = F.array_intersect(selected, available)
    return F.when(F.array_contains(kept, item), F.array_except(kept, F.array(item))).otherwise(F.array_union(kept, F.array_intersect(F.array(item), available)))
