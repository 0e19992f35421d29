"""Session settings that results and a task's memory depend on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Spark 4.1 may take a union of two co-partitioned inputs as co-partitioned itself; with adaptive execution their
#: partitions can then be paired wrongly, and windows over the union lose rows. Checked with 4.1.2: off.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false"}
#: Bytes that adaptive execution gives to a task after a shuffle, at most. Sorted numbers take some 25 bytes a row there and 30 times
#: that in the sorts, windows and aggregates of a stage, so a task at Spark's 64 MB may hold gigabytes.
TASK_BYTES = 8 << 20
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _bytes(size: str) -> int:
    """A size as Spark writes it, like 64MB, 8m or 16777216b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if _bytes(spark.conf.get(_ADVISORY)) > TASK_BYTES:
        spark.conf.set(_ADVISORY, f"{TASK_BYTES}b")
    return spark
