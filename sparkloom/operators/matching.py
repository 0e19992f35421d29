"""Join-shaped operators: overlaps, exact matches, range shifts, positional comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def live_and_history(live: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """All live rows, and the history rows whose key is not live."""
    return live.withColumn("live", F.lit(True)).unionByName(history.join(live.select(key), key, "left_anti").withColumn("live", F.lit(False)))


def overlaps(ranges: DataFrame, key: str, start: str, stop: str, id_: str) -> DataFrame:
    """(key, id, other): pairs of closed ranges of one key that share a position, each pair once.

    Ranges are dealt to the blocks that they touch, with blocks as long as the longest range of the key, so a join meets
    two neighbouring blocks rather than all ranges of a key.
    """
    width = F.greatest(F.max(F.col(stop) - F.col(start)).over(W.partitionBy(key)) + 1, F.lit(1))
    rows = ranges.withColumn("width", width)
    block = F.floor(F.col(start) / F.col("width"))
    a = rows.select(F.col(key).alias("k"), F.col(id_).alias("a"), F.col(start).alias("a0"), F.col(stop).alias("a1"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    b = rows.select(F.col(key).alias("k"), F.col(id_).alias("b"), F.col(start).alias("b0"), F.col(stop).alias("b1"), block.alias("block"))
    return a.join(b, ["k", "block"]).where("a < b AND a0 <= b1 AND b0 <= a1").select(F.col("k").alias(key), F.col("a").alias(id_), F.col("b").alias("other"))


def exact_matches(rows: DataFrame, value: Column, catalog: DataFrame, label: str, catalog_value: Column) -> DataFrame:
    """Rows joined to every catalog entry with the same content, by digest; Spark broadcasts the catalog if it is small."""
    known = catalog.select(F.col(label).alias("label"), F.sha2(catalog_value, 256).alias("digest"))
    return rows.withColumn("digest", F.sha2(value, 256)).join(known, "digest")


def removed_shift(points: DataFrame, key: str, at: str, removed: DataFrame, start: str, stop: str) -> DataFrame:
    """Add ``inside`` (within a removed half-open interval) and ``shift`` (removed length before the point).

    Points and interval ends are merged into one ordered stream per key and summed, instead of joining them by range.
    """
    marks = removed.select(F.col(key).alias("k"), F.col(stop).cast("double").alias("t"), F.lit(0).alias("kind"), (F.col(stop) - F.col(start)).cast("double").alias("gone"), F.lit(-1).alias("open"))
    marks = marks.unionByName(removed.select(F.col(key).alias("k"), F.col(start).cast("double").alias("t"), F.lit(0).alias("kind"), F.lit(0.0).alias("gone"), F.lit(1).alias("open")))
    stream = points.withColumns({"k": F.col(key), "t": F.col(at).cast("double"), "kind": F.lit(1), "gone": F.lit(0.0), "open": F.lit(0)})
    w = W.partitionBy("k").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    merged = stream.unionByName(marks, allowMissingColumns=True).withColumns({"shift": F.sum("gone").over(w), "depth": F.sum("open").over(w)})
    return merged.where("kind = 1").select(*points.columns, (F.col("depth") > 0).alias("inside"), "shift")


def zip_compare(source: DataFrame, output: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, position, equal): two sequences position by position; a missing position is unequal."""
    number = lambda df, name: df.select(key, (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).alias("position"), F.col(value).alias(name))
    both = number(source, "a").join(number(output, "b"), [key, "position"], "full_outer")
    return both.select(key, "position", (F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull()).alias("equal"))


def neighbours(candidates: DataFrame, regions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each candidate with columns of the regions directly before and after it; null at the edges."""
    side = lambda name, shift: regions.select(key, (F.col("region") + shift).alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    out = candidates.join(side("before", 1).withColumnRenamed("before", "first_region"), [key, "first_region"], "left")
    return out.join(side("after", -1).withColumnRenamed("after", "last_region"), [key, "last_region"], "left")


def novel(inside: DataFrame, outside: DataFrame, key: str, value: str, time: str, least: int = 2) -> DataFrame:
    """(key, value, times): values seen at ``least`` distinct times inside and never outside."""
    seen = inside.groupBy(key, value).agg(F.count_distinct(time).alias("times")).where(F.col("times") >= least)
    return seen.join(outside.select(key, value).distinct(), [key, value], "left_anti")
