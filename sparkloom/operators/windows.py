"""Overlapping windows over a duration, and decisions about decoded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_count(total: Column, window: int, overlap: int) -> Column:
    """How many windows of a length cover a total when neighbours share an overlap."""
    step = window - overlap
    return F.when(total <= 0, 0).when(total <= window, 1).otherwise(F.floor((total - window - 1) / step) + 2).cast("int")


def plan_windows(df: DataFrame, total: Column, window: int, overlap: int) -> DataFrame:
    """A row per window: index, start, stop; the last one is cut at the total."""
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be shorter than the window")
    n = window_count(total, window, overlap)
    step = window - overlap
    out = df.withColumn("total", total).withColumn("index", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    start = F.col("index").cast("long") * step
    return out.withColumns({"start": start, "stop": F.least(start + window, "total")})


def window_decision(total: Column, index: Column, samples: Column, window: int, overlap: int, rate: int) -> Column:
    """missing, end, last or more, for a decoded window; a null or non-positive total is unknown."""
    planned = F.when(total > 0, window_count(total, window, overlap))
    full, shared = window * rate // 1000, overlap * rate // 1000
    tolerance = min(full - 1, max(1, rate // 4))
    expected = F.coalesce(index < planned, F.lit(False))
    last = expected & (index == planned - 1)
    return (
        F.when((samples == 0) & ((index == 0) | expected), "missing")
        .when(samples == 0, "end")
        .when(~expected & (index > 0) & (samples <= shared), "end")
        .when(~expected | ~F.coalesce(last, F.lit(False)) | (samples >= full - tolerance), "more")
        .otherwise("last")
    )


def inference_slices(df: DataFrame, samples: Column, most: int, overlap: int) -> DataFrame:
    """Slices of at most ``most`` samples; the last one ends at the end and is never an overlap alone."""
    return plan_windows(df, samples, most, overlap)


def even_sample(n: Column, most: int = 30) -> Column:
    """At most ``most`` distinct indices spread evenly over 0 .. n-1, halves rounded to even."""
    k = F.least(n, F.lit(most))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int")))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<int>"))
