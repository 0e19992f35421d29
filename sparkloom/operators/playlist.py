"""Regions of a playlist, contiguous candidates, and a disjoint selection of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_SECONDS = 60.0
SLACK = 1e-9


def regions(segments: DataFrame, key: str, order: str, seconds: str, breaks: Column) -> DataFrame:
    """(key, region, seconds, first_segment, last_segment): runs of segments between breaks.

    ``breaks`` is the number of region borders directly before a segment: more than one leaves empty regions, which
    are rows too.
    """
    w = W.partitionBy(key).orderBy(order)
    numbered = segments.withColumns({"segment": F.row_number().over(w) - 1, "region": F.sum(breaks).over(w)})
    full = numbered.groupBy(key, "region").agg(F.sum(seconds).alias("seconds"), F.min("segment").alias("first_segment"), F.max("segment").alias("last_segment"))
    # a region with its own row also makes the rows of the empty ones directly before it
    previous = F.coalesce(F.lag("region").over(W.partitionBy(key).orderBy("region")), F.lit(-1).cast("long"))
    spread = full.withColumn("previous", previous).withColumn("r", F.explode(F.sequence(F.col("previous") + 1, F.col("region"))))
    own = F.col("r") == F.col("region")
    return spread.select(key, F.col("r").alias("region"), F.when(own, F.col("seconds")).otherwise(0.0).alias("seconds"), F.when(own, F.col("first_segment")).alias("first_segment"), F.when(own, F.col("last_segment")).alias("last_segment"))


def candidates(regions_: DataFrame, key: str, most: float = MOST_SECONDS) -> DataFrame:
    """(key, first_region, last_region, seconds, first_segment, last_segment) of every contiguous run without empty regions.

    A run's end lies within a band of running sums behind its start. Running sums are dealt over blocks a little wider than the
    limit, and a start meets the ends of its own block and the next one only: regions further apart never meet, however
    long a stretch is.
    """
    w = W.partitionBy(key).orderBy("region")
    gap = F.sum(F.col("first_segment").isNull().cast("int")).over(w)
    summed = regions_.withColumns({"stretch": gap, "sum": F.sum("seconds").over(w)}).where("first_segment IS NOT NULL")
    block = lambda x: F.floor(x / (most + 4 * SLACK + most * 1e-9))
    before = F.col("sum") - F.col("seconds")
    a = summed.select(key, "stretch", F.col("region").alias("first_region"), before.alias("before"), "first_segment", F.explode(F.array(block(before), block(before) + 1)).alias("block"))
    z = summed.select(F.col(key).alias("z_key"), F.col("stretch").alias("z_stretch"), F.col("region").alias("last_region"), "sum", "last_segment", block(F.col("sum")).alias("z_block"))
    near = (F.col(key) == F.col("z_key")) & (F.col("stretch") == F.col("z_stretch")) & (F.col("block") == F.col("z_block"))
    near = near & (F.col("first_region") <= F.col("last_region")) & (F.col("sum") - F.col("before") <= most + SLACK)
    return a.join(z, near).select(key, "first_region", "last_region", (F.col("sum") - F.col("before")).alias("seconds"), "first_segment", "last_segment")


def select_disjoint(scored: DataFrame, key: str, threshold: float = 55.0, known: DataFrame | None = None) -> DataFrame:
    """Add ``selection`` and ``blocked``: passing rows by descending score, shorter first, take what no earlier choice overlaps.

    ``known``: (key, first_region, last_region, first_segment, last_segment) of groups that are taken before all others; they give no
    rows. ``blocked`` lists the regions of the choices that a row overlaps, in the order in which they were made. Choices depend on each
    other only within a stretch of overlapping passing rows and known groups, so these stretches are the groups: a
    key's rows are split wherever no row crosses.
    """
    names = scored.columns
    spans = "array<struct<first_region:bigint,last_region:bigint>>"
    rows = scored.withColumn("passing", F.coalesce(F.col("valid") & (F.col("score") >= threshold), F.lit(False)))
    passing = rows.where("passing").drop("passing").withColumn("known", F.lit(False))
    if known is not None:
        passing = passing.unionByName(known.select(key, "first_region", "last_region", "first_segment", "last_segment").withColumn("known", F.lit(True)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("first_segment", "last_segment").rowsBetween(W.unboundedPreceding, -1)
    begins = (F.col("first_segment") > F.coalesce(F.max("last_segment").over(w), F.lit(-1))).cast("int")
    grouped = passing.withColumn("begins", begins)
    grouped = grouped.withColumn("island", F.sum("begins").over(W.partitionBy(key).orderBy("first_segment", "last_segment"))).drop("begins")
    grouped = grouped.withColumn("alone", F.count("*").over(W.partitionBy(key, "island")) == 1)
    none = F.array().cast(spans)
    alone = grouped.where("alone AND NOT known").select(*names, F.lit("selected").alias("selection"), none.alias("blocked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by island and rank, so one island's choices are held at a time."""
        now, taken = None, []
        for b in batches:
            out, hits = [], []
            own = b.column("known").to_pylist()
            for k, island, a, z, r, s, there in zip(*(b.column(n).to_pylist() for n in (key, "island", "first_segment", "last_segment", "first_region", "last_region")), own, strict=True):
                if now != (k, island):
                    now, taken = (k, island), []
                hit = [] if there else [{"first_region": t[2], "last_region": t[3]} for t in taken if not (z < t[0] or a > t[1])]
                if not hit:
                    taken.append((a, z, r, s))
                out.append("overlapped" if hit else "selected")
                hits.append(hit)
            kept = pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(out, pa.string()), pa.array(hits, pa.list_(pa.struct([("first_region", pa.int64()), ("last_region", pa.int64())])))], names=[*names, "selection", "blocked"])
            yield kept.filter(pa.array([not x for x in own]))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in scored.schema]
    ranked = grouped.where("NOT alone").repartition(key, "island").sortWithinPartitions(key, "island", F.desc("known"), F.desc("score"), "seconds", "first_region", "last_region")
    chosen = ranked.mapInArrow(run, ", ".join([*fields, "selection string", f"blocked {spans}"])).unionByName(alone)
    return chosen.unionByName(rows.where("NOT passing").select(*names, F.lit("unknown").alias("selection"), none.alias("blocked")))


def keep_some(selected: DataFrame, key: str, total: Column) -> DataFrame:
    """Clear a selection that would remove everything: ``total`` is the number of a key's segments."""
    gone = F.sum(F.when(F.col("selection") == "selected", F.col("last_segment") - F.col("first_segment") + 1).otherwise(0)).over(W.partitionBy(key))
    return selected.withColumn("selection", F.when((F.col("selection") == "selected") & (gone >= total), "cleared").otherwise(F.col("selection")))
