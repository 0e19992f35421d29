"""Operator 9: mixing sources to target weights by entropy balancing.

A document's rate is the expected number of its copies. Of all rates between 0 and ``most`` that meet a source's word
target, those with the least relative entropy to one copy each, sum(rate * log(rate) - rate), are taken. Their Lagrangian
dual is convex in one unknown lambda per source, and its solution tilts exponentially, cut at the bound:
rate = min(most, exp(lambda * size / mean size of the source)). Newton iterations solve it; gradient and curvature are sums
over the documents, taken by Spark in each iteration. As a rate depends on source and size only, the sums run over
(source, size) cells. Steps are kept within a bracket that every gradient narrows, so the iteration ends: where no
double lies between the ends any more, if not before.

Rounding: within a source, cells in descending order of size take whole copies, each carrying its error in words on to
the next. A source ends within its smallest document of its target, unless all documents that are small enough to
close the gap are at a bound already. Cells stream through a task in order, with one number carried; there are as many as
a source has different sizes. A cell's copies are dealt evenly over its documents, and the rest to those that come
first by a hash of id and text. Ranks are counted in hash buckets first, so a cell with a third of all documents is
spread. Nothing depends on partitioning or chance: reruns agree.

The driver holds a few numbers for each source, no more. Defined cases: a null text has size 0; a null source is a
source and comes last; documents of size 0 are taken 0 words and keep one copy; repeated rows are documents of their
own; null ids are ids; texts of any length count whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 1024


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all by repeating weights, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    # sources fill up in the order of size by weight; behind the first that does not, none does
    out: dict[str | None, float] = {}
    rest, total = share * sum(sizes.values()), float(sum(weight.values()))
    by_room = sorted(order, key=lambda s: sizes[s] / weight[s])
    for i, s in enumerate(by_room):
        if rest * weight[s] <= most * sizes[s] * total:
            return out | {x: rest * weight[x] / total for x in by_room[i:]}
        out[s] = float(most * sizes[s])
        rest -= out[s]
        total -= weight[s]
    return out


def _rate(x: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(x * size / mean))


def _solve(cells: DataFrame, sources: dict[str | None, dict], most: float) -> dict[str | None, float]:
    """lambda of every source whose target lies strictly between 0 and ``most`` times its size."""
    spark = cells.sparkSession
    state = {s: {"x": math.log(v["target"] / v["size"]), "lo": -math.inf, "hi": math.inf} for s, v in sources.items() if 0 < v["target"] < most * v["size"] * (1 - 1e-12)}
    done: dict[str | None, float] = {}
    mass, rate = F.col("n") * F.col("size"), _rate(F.col("x"), F.col("size"), F.col("mean"), most)
    slope = F.when(F.col("rate") < float(most), mass * F.col("size") / F.col("mean") * F.col("rate")).otherwise(F.lit(0.0))
    while state:
        at = spark.createDataFrame([(s, v["x"], sources[s]["mean"]) for s, v in state.items()], "at string, x double, mean double")
        sums = cells.join(at, cells.source.eqNullSafe(at["at"])).withColumn("rate", rate).groupBy("source")
        for r in sums.agg(F.sum(mass * F.col("rate")).alias("got"), F.sum(slope).alias("slope")).collect():
            v, goal = state[r.source], sources[r.source]["target"]
            gap = r.got - goal
            v["hi" if gap > 0 else "lo"] = v["x"]
            step = v["x"] - gap / r.slope if r.slope > 0 else math.nan
            if not v["lo"] < step < v["hi"] or not math.isfinite(step):
                step = (v["lo"] + v["hi"]) / 2 if math.isfinite(v["lo"] + v["hi"]) else 2 * v["x"] - math.copysign(1, gap)
            # rounding moves far more than a hundredth of a word, or a ten-millionth of the target
            if abs(gap) <= max(1e-7 * goal, 0.01) or step in (v["x"], v["lo"], v["hi"]):
                done[r.source] = v["x"]
                del state[r.source]
            else:
                v["x"] = step
    return done


def _whole(rated: DataFrame, most: int) -> DataFrame:
    """Whole copies of the cells of each source; cells arrive sorted by source and descending size."""
    names = ["source", "size", "n", "source_size", "target", "rate", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, debt = None, 0.0
        for b in batches:
            copies = []
            for source, size, n, rate in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
                if last != (source,):
                    last, debt = (source,), 0.0
                if size:
                    copies.append(min(most * n, max(0, math.floor(n * rate + debt / size + 0.5))))
                    debt += (n * rate - copies[-1]) * size
                else:
                    copies.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(copies, pa.int64())], names=names)

    rows = rated.repartition("source").sortWithinPartitions("source", F.desc("size"))
    return rows.mapInArrow(run, "source string, size long, n long, source_size long, target double, rate double, copies long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, digest, source, size, source_size, target, rate, copies, taken) of every row."""
    spark = common.session(docs.sparkSession)
    used: list[str] = []
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.unhex(F.md5(text)).alias("digest"))
    sized = common.staged(sized.withColumn("tie", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "digest")), "sizes", used)
    cells = common.staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells", used)
    totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("docs")).collect()
    want = targets({r.source: r["size"] for r in totals}, weights, share, most)
    sources = {r.source: {"size": r["size"], "mean": max(r["size"] / r.docs, 1e-9), "target": float(want[r.source])} for r in totals}
    solved = _solve(cells.where("size > 0"), sources, most)
    rows = [(s, v["size"], v["target"], v["mean"], solved.get(s, math.inf if v["target"] > 0 else -math.inf)) for s, v in sources.items()]
    plan = spark.createDataFrame(rows, "at string, source_size long, target double, mean double, x double")

    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("x") == math.inf, F.lit(float(most))).when(F.col("x") == -math.inf, F.lit(0.0))
    rate = rate.otherwise(_rate(F.col("x"), F.col("size"), F.col("mean"), most))
    rated = cells.join(plan, cells.source.eqNullSafe(plan["at"])).select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    dealt = common.staged(_whole(rated, most), "dealt", used)
    dealt = dealt.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "source_size", "target", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra"))

    # exact ranks by (tie, id) within a cell: ranks within hash buckets, plus the sizes of the buckets before
    bucket = F.shiftrightunsigned("tie", 64 - int(math.log2(BUCKETS)))
    tied = sized.withColumn("bucket", bucket)
    size_of = tied.groupBy("source", "size", "bucket").agg(F.count("*").alias("here"))
    ahead = F.coalesce(F.sum("here").over(W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size_of = size_of.withColumn("ahead", ahead).select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "ahead")
    ranked = tied.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy(F.shiftleft("tie", int(math.log2(BUCKETS))), "doc_id")))
    ranked = ranked.join(size_of, ranked.source.eqNullSafe(size_of.b_source) & (ranked["size"] == size_of.b_size) & (ranked.bucket == size_of.b_bucket))
    out = ranked.join(dealt, ranked.source.eqNullSafe(dealt.c_source) & (ranked["size"] == dealt.c_size))
    copies = F.col("each") + F.when(F.col("ahead") + F.col("rank") <= F.col("extra"), F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", copies.cast("long")).select("doc_id", "digest", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    out = common.staged(out, "mix")
    common.drop(spark, *used)
    return out


def mixed_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as the mix takes it."""
    key, digest, copies = common.fresh(docs, "key", "digest", "copies")
    rows = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))))
    take = mixed.groupBy(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest")).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    rows = rows.join(take, rows[key].eqNullSafe(take.m_id) & (rows[digest] == take.m_digest)).dropDuplicates([key, digest])
    return rows.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
