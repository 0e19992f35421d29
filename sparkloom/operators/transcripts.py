"""Transcript operators: caption text and the merging of overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Scripts written without blanks between words, as Java block names (fixed values).
BLOCKS = ("CJK_UNIFIED_IDEOGRAPHS", "CJK_UNIFIED_IDEOGRAPHS_EXTENSION_A", "CJK_COMPATIBILITY_IDEOGRAPHS", "CJK_SYMBOLS_AND_PUNCTUATION", "HALFWIDTH_AND_FULLWIDTH_FORMS", "HIRAGANA", "KATAKANA", "HANGUL_SYLLABLES")
CJK = "[" + "".join(f"\\p{{In{b}}}" for b in BLOCKS) + "]"


def is_cjk(char: Column) -> Column:
    return F.rlike(char, F.lit(CJK))


def join_seam(left: Column, right: Column, most: int = 400) -> Column:
    """Two parts as one text: the longest suffix of the left that starts the right is kept once.

    It must have four characters (two where the left ends in a script without blanks). Without such a seam they are
    joined by a blank, unless both sides of the border are in such a script.
    """
    end = F.right(left, F.lit(1))
    least = F.when(is_cjk(end), 2).otherwise(4)
    longest = F.least(F.length(left), F.length(right), F.lit(most))
    lengths = F.when(longest >= least, F.sequence(longest, least, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    seam = F.get(F.filter(lengths, lambda n: F.right(left, n) == F.left(right, n)), F.lit(0))
    blank = F.when(is_cjk(end) & is_cjk(F.left(right, F.lit(1))), F.lit("")).otherwise(F.lit(" "))
    return F.when(left == "", right).when(right == "", left).when(seam.isNull(), F.concat(left, blank, right)).otherwise(F.concat(left, F.substr(right, seam + 1)))


def merge_parts(parts: Column) -> Column:
    """All parts of an array, in order, joined at their seams; blank parts are skipped."""
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.aggregate(clean, F.lit(""), lambda left, right: join_seam(left, right))


def collapse_repeats(lines: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Lines that differ from the line kept before them; blank lines are dropped first."""
    full = lines.where(F.trim(value) != "")
    return full.withColumn("before", F.lag(value).over(W.partitionBy(key).orderBy(order))).where(~F.col("before").eqNullSafe(F.col(value))).drop("before")


def caption_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, value): the spoken lines of a caption file, without header, cues, notes, tags and repeats."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    order = W.partitionBy(key).orderBy("line")
    stamp = F.contains("raw", F.lit("-->"))
    marked = lines.withColumns({"cue": F.max(stamp).over(order), "next_stamp": F.coalesce(F.contains(F.lead("raw").over(order), F.lit("-->")), F.lit(False))})
    header = ~F.col("cue") & F.rlike("raw", F.lit(r"^(WEBVTT|Kind:|Language:|STYLE|REGION|X-TIMESTAMP-MAP)"))
    note = F.rlike("raw", F.lit(r"^NOTE(\s|$)"))
    index = F.rlike("raw", F.lit(r"^\d+$")) & F.col("next_stamp")
    spoken = marked.where((F.col("raw") != "") & ~stamp & ~note & ~header & ~index).select(key, "line", F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("value"))
    return collapse_repeats(spoken, key, "line", "value")
