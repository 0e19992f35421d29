"""Frame, audio and text features as aggregates of built-in expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import even_sample


def nearest_rank(value: str, fraction: float) -> Column:
    """Nearest-rank percentile of a group; null for an empty one."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")


def mean_absolute_error(a: Column, b: Column, scale: float = 255.0) -> Column:
    """Mean of |a - b| over two arrays, in parts of ``scale``."""
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), zero, lambda s, x: s + x) / (F.size(a) * scale)


def adjacent_errors(frames: DataFrame, key: str, order: str, pixels: str) -> DataFrame:
    """(key, order, mae): each frame against the one before it."""
    before = F.lag(pixels).over(W.partitionBy(key).orderBy(order))
    return frames.withColumn("before", before).where("before IS NOT NULL").select(key, order, mean_absolute_error(F.col(pixels), F.col("before")).alias("mae"))


def edge_window(frames: DataFrame, key: str, time: str, seconds: float = 1.0) -> DataFrame:
    """Rows within ``seconds`` of either end of their key's time span, ends included."""
    w = W.partitionBy(key)
    near = (F.col(time) <= F.min(time).over(w) + seconds) | (F.col(time) >= F.max(time).over(w) - seconds)
    return frames.withColumn("near_edge", near).where("near_edge").drop("near_edge")


def frame_gap(frames: DataFrame, key: str, time: str) -> DataFrame:
    """(key, median_gap): the median positive distance of neighbouring frames."""
    gap = F.lead(time).over(W.partitionBy(key).orderBy(time)) - F.col(time)
    return frames.withColumn("gap", gap).where("gap > 0").groupBy(key).agg(F.median("gap").alias("median_gap"))


def top_bin_share(pixels: DataFrame, key: str, red: str, green: str, blue: str) -> DataFrame:
    """(key, top_share, dark_share): the share of the fullest of 8 x 8 x 8 colour bins, and of pixels of 16 at most throughout."""
    bin_ = F.floor(F.col(red) / 32) * 64 + F.floor(F.col(green) / 32) * 8 + F.floor(F.col(blue) / 32)
    dark = (F.greatest(red, green, blue) <= 16).cast("int")
    per = pixels.groupBy(key, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(dark).alias("dark"))
    return per.groupBy(key).agg((F.max("n") / F.sum("n")).alias("top_share"), (F.sum("dark") / F.sum("n")).alias("dark_share"))


#: Profiles of a summary, and the mean error up to which neighbouring frames stand still (fixed values).
PROFILES, NEAR_STATIC = ("full", "weighted_decision"), 1 / 255


def visual_summary(frames: DataFrame, profile: str) -> DataFrame:
    """AGG-05, (key, frame_count, sample_count, top_color_bin_median, black_pixel_fraction_median, adjacent_mae_median, near_static, native_adjacent_count, native_adjacent_mae_p90).

    Frames: key, role (before, after or another), i from 0, time, pixels (red, green, blue, red, ...). Colours are those of at most 30 frames, evenly
    spread; native movement is that of the pairs within a second of the edge that meets the candidate. ``weighted_decision`` needs
    native movement on the two sides alone: all else is null there, and errors of other pairs are not computed.
    """
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}")
    own = W.partitionBy("key")
    in_order = own.orderBy("i")
    rows = frames.withColumns({"n": F.count("*").over(own), "next": F.lead(F.struct("time", "pixels")).over(in_order), "first": F.min("time").over(own), "last": F.max("time").over(own)})
    near = F.when(F.col("role") == "before", F.col("time") >= F.col("last") - 1).otherwise(F.col("next.time") <= F.col("first") + 1) & F.col("next").isNotNull()
    wanted = near & F.col("role").isin("before", "after") if profile == "weighted_decision" else F.col("next").isNotNull()
    rows = rows.withColumn("mae", F.when(wanted, mean_absolute_error(F.col("pixels"), F.col("next.pixels")))).withColumn("native", F.when(near, F.col("mae")))
    pairs = rows.groupBy("key", "role").agg(F.count("*").alias("frame_count"), F.median("mae").alias("middle"), F.count("native").alias("count"), nearest_rank("native", 0.9).alias("p90"))
    if profile == "weighted_decision":
        side = F.col("role").isin("before", "after")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("sample_count", "long"), ("top_color_bin_median", "double"), ("black_pixel_fraction_median", "double"), ("adjacent_mae_median", "double"), ("near_static", "boolean"))]
        return pairs.select("key", "frame_count", *none, F.when(side, F.col("count")).alias("native_adjacent_count"), F.when(side, F.col("p90")).alias("native_adjacent_mae_p90"))
    picked = rows.where(F.array_contains(even_sample(F.col("n").cast("int")), F.col("i").cast("int"))).select("key", "i", F.posexplode(F.sequence(F.lit(1), F.size("pixels") - 2, F.lit(3))).alias("k", "at"), "pixels")
    channels = [F.element_at("pixels", F.col("at") + j).alias(c) for j, c in enumerate(("r", "g", "b"))]
    colours = top_bin_share(picked.select(F.struct("key", "i").alias("f"), *channels), "f", "r", "g", "b")
    colours = colours.groupBy(F.col("f.key").alias("key")).agg(F.count("*").alias("sample_count"), F.median("top_share").alias("top_color_bin_median"), F.median("dark_share").alias("black_pixel_fraction_median"))
    still = F.coalesce(F.col("middle") <= NEAR_STATIC, F.lit(False))
    out = pairs.join(colours, "key", "left")
    return out.select("key", "frame_count", "sample_count", "top_color_bin_median", "black_pixel_fraction_median", F.col("middle").alias("adjacent_mae_median"), still.alias("near_static"), F.col("count").alias("native_adjacent_count"), F.col("p90").alias("native_adjacent_mae_p90"))


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def peak(value: Column) -> Column:
    return F.max(F.abs(value))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def gain_quality(candidate_rms: Column, candidate_peak: Column, outside_rms: Column, outside_peak: Column, full_db: float = 12.0) -> Column:
    """clamp(20 log10(c / o) / full_db); null where either side is at the numerical floor."""
    usable = (candidate_rms > 0) & (outside_rms > 0) & (candidate_peak > 1) & (outside_peak > 1)
    return F.when(usable, clamp(20 * F.log10(candidate_rms / outside_rms) / full_db))


def digital_silence(samples: Column) -> Column:
    """Whether there are samples and all of them are zero."""
    return (F.size(samples) > 0) & F.forall(samples, lambda x: x == 0)


def rect_area(rects: Column) -> Column:
    """The integral of the largest weight over the union of an array of rectangles, struct<x0, y0, x1, y1, weight>; 0 if none has an area.

    The rectangles' sides cut the plane into strips, and those that cover a strip cut it into cells; each cell counts with the largest
    weight that covers it.
    """
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def summed(held: Column, lo: str, hi: str, height: Callable[[Column], Column]) -> Column:
        """The sum of length times ``height`` of those that cover it, over the pieces between the sides."""
        sides = F.array_sort(F.array_distinct(F.flatten(F.transform(held, lambda r: F.array(r[lo], r[hi])))))
        pieces = let(sides, lambda s: F.filter(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, z: F.struct(a.alias("a"), z.alias("z"))), lambda p: p["z"].isNotNull()))
        return F.aggregate(pieces, F.lit(0.0), lambda t, p: t + (p["z"] - p["a"]) * height(F.filter(held, lambda r: (r[lo] <= p["a"]) & (r[hi] >= p["z"]))))

    top = lambda held: F.coalesce(F.array_max(F.transform(held, lambda r: r["weight"])), F.lit(0.0))
    good = F.filter(rects, lambda r: (r["weight"] > 0) & (r["x1"] > r["x0"]) & (r["y1"] > r["y0"]))
    return let(good, lambda all_: summed(all_, "x0", "x1", lambda strip: let(strip, lambda held: summed(held, "y0", "y1", top))))


def rect_union(rects: DataFrame, key: str) -> DataFrame:
    """(key, area): the integral of the largest weight over the union of weighted rectangles (x0, y0, x1, y1, weight).

    A key is one frame, whose number of rectangles is limited by its producer (64 observations), so they are gathered into one array:
    one shuffle and one sort, where joins of rectangles to the cells they cover held several tables at once.
    """
    held = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "weight")))
    return rects.where("weight > 0 AND x1 > x0 AND y1 > y0").groupBy(key).agg(F.collect_list(held).alias("_rects")).select(key, rect_area(F.col("_rects")).alias("area"))


def exclusive_time(spans: DataFrame, key: str) -> DataFrame:
    """(key, category, seconds) of nested spans (start, stop, depth, category): time goes to the innermost open span."""
    edges = spans.select(key, F.explode(F.array("start", "stop")).alias("lo")).distinct()
    edges = edges.withColumn("hi", F.lead("lo").over(W.partitionBy(key).orderBy("lo"))).where("hi IS NOT NULL")
    cover = edges.join(spans, key).where("start <= lo AND stop >= hi")
    inner = cover.groupBy(key, "lo", "hi").agg(F.max_by("category", "depth").alias("category"))
    return inner.groupBy(key, "category").agg(F.sum(F.col("hi") - F.col("lo")).alias("seconds"))


def ordered_digest(rows: DataFrame, key: str, order: list[str], value: Column, prefix: int = 4096, around: tuple[str, str, str] = ("", "\n", "\n")) -> DataFrame:
    """(key, n, digest, kept, kept_digest): SHA-256 over a group's values in order, and over its first ``prefix`` ones.

    ``around``: what stands before all values, between two of them, and after the last. With ("[", ",", "]") and canonical JSON
    as values this is the digest of their canonical array. Rows stream through a task in order; it holds two digests, however
    large a group is. A digest is sequential, so one group is one task's work. Null values count as empty.
    """
    head, between, tail = (x.encode() for x in around)
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, n long, digest string, kept long, kept_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, whole, first = None, 0, None, None
        names = [key, "n", "digest", "kept", "kept_digest"]

        def close() -> tuple:
            whole.update(tail)
            if n <= prefix:
                first.update(tail)
            return (now[0], n, whole.hexdigest(), min(n, prefix), first.hexdigest())

        for b in batches:
            done = []
            for k, v in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if now != (k,):
                    if now is not None:
                        done.append(close())
                    now, n, whole, first = (k,), 0, hashlib.sha256(head), hashlib.sha256(head)
                part = (between if n else b"") + v.encode()
                n += 1
                whole.update(part)
                if n <= prefix:
                    first.update(part)
                elif n == prefix + 1:
                    first.update(tail)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate([b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string()])], names)
        if now is not None:
            d = close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(d, [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string()], strict=True)], names)

    columns = rows.select(key, *(F.col(c) for c in order if c != key), F.coalesce(value, F.lit("")).alias("_value"))
    return columns.repartition(key).sortWithinPartitions(key, *(c for c in order if c != key)).mapInArrow(run, schema)
