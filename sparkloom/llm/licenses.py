"""Operator 8: licence scans by the Dice coefficient over word bigrams, in native expressions only.

A text is lower-cased; its words are runs of letters and digits. A licence has templates (short texts, headers and
notices; long licences are known by these alone). A template of n words meets windows of n words of the text, wherever lines break and whatever stands around
them; at a text's ends windows are shorter. A window matches if twice the number of word bigrams it shares with the
template is at least ``percent`` / 100 of both numbers of distinct bigrams together.

Candidates come from an index. Of b bigrams a match shares at least b * percent / (200 - percent), so it has one of any
b - that + 1 of them: those that fewest templates hold are indexed, with their first place in the template. Where a text has an indexed
bigram, the window that lies on the template in that place is compared. Size bounds prune it first: windows with fewer
words than the least that can match are dropped before their bigrams are made. Insertions before the indexed bigram shift the window
by as much; a match is one aligned window, as defined here, and the SQL version says the same. Where matches overlap, only
those stay that overlap no better one (higher coefficient, then more words, then the first licence by name, then place), so
licences of one family are told apart.

A text is scanned in pieces, so work grows with its length only. Words meet the index in a join inside code generation; only candidates go on, with their piece, and only matches are shuffled. The index is
broadcast as its size is known: it is made from templates that the caller gives (``MOST_BROADCAST`` rows at most, else it
is a shuffled join). Defined cases: null and empty texts have no words and no matches; a text of one word has no
bigrams; ties go to the first window; repeated rows each get the matches of their text; null ids stay; texts of any
length are read whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES
from .quality import let

MOST_BROADCAST = 1 << 16
#: Words in a piece of a text, at least.
STEP = 512
WORD = r"[\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, in order of their first place."""
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def index(templates: dict[str, tuple[str, ...]], percent: int) -> tuple[list[tuple], list[tuple]]:
    """(template, licence, words, bigrams) of every template, and (bigram, template, place) of the indexed bigrams."""
    known = [(license_, text) for license_, texts in sorted(templates.items()) for text in texts if len(words(text)) > 1]
    if not known:
        raise ValueError("no template has two words")
    grams = [bigrams(text) for _, text in known]
    held = Counter(g for gs in grams for g in gs)
    entries = []
    for t, ((_, text), gs) in enumerate(zip(known, grams, strict=True)):
        w = words(text)
        place: dict[str, int] = {}
        for i, pair in enumerate(zip(w, w[1:], strict=False)):
            place.setdefault(" ".join(pair), i)
        least = -(-len(gs) * percent // (200 - percent))
        rare = sorted(gs, key=lambda g: (held[g], -len(g), g))[: len(gs) - least + 1]
        entries += [(g, t, place[g]) for g in rare]
    return [(t, license_, len(words(text)), gs) for t, ((license_, text), gs) in enumerate(zip(known, grams, strict=True))], entries


def _bigrams(w: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_BROADCAST else table


def matches(texts: DataFrame, templates: dict[str, tuple[str, ...]], percent: int, paths: list[str] | None = None) -> DataFrame:
    """(digest, matches) of (digest, text): an array of structs of license, start, words and dice, ascending by place."""
    spark = texts.sparkSession
    table, entries = index(templates, percent)
    known = _small(spark, [(t, license_, n, gs, len(gs)) for t, license_, n, gs in table], "t int, license string, n int, grams array<string>, b int")
    first = _small(spark, [(*g.split(" "), t, o) for g, t, o in entries], "a string, z string, t int, o int")
    reach = max(n for _, _, n, _ in table)
    step = max(STEP, reach)
    split = texts.select("digest", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w")).withColumn("total", F.size("w"))
    # pieces of a text with the words around them that windows reach into: a candidate takes its piece along, not the text
    begins = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.col("total") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    piece = lambda at: F.struct(at.alias("at"), F.greatest(at - reach, F.lit(0)).alias("low"), F.slice("w", F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)) + step + reach).alias("w"))
    pieces = split.select("digest", "total", F.explode(F.transform(begins, piece)).alias("piece")).select("digest", "total", "piece.*")
    placed = pieces.select("digest", "total", "at", "low", "w", F.posexplode("w").alias("i", "a")).withColumns({"p": F.col("low") + F.col("i"), "z": F.get("w", F.col("i") + 1)})
    placed = placed.where((F.col("p") >= F.col("at")) & (F.col("p") < F.col("at") + step))
    found = placed.join(first, ["a", "z"]).join(known, "t")
    start, stop = F.greatest(F.col("p") - F.col("o"), F.lit(0)), F.least(F.col("p") - F.col("o") + F.col("n"), F.col("total"))
    found = found.select("digest", "license", "grams", "b", start.alias("start"), (stop - start).alias("m"), "low", "w")
    # a window of m words has m - 1 bigrams at most, and must share that many
    found = found.where((F.col("m") - 1) * (200 - percent) >= F.col("b") * percent)
    window = F.slice("w", F.col("start") - F.col("low") + 1, F.col("m"))
    dice = let(_bigrams(window), lambda g: 2 * F.size(F.array_intersect(F.col("grams"), g)) / (F.size(g) + F.col("b")))
    scored = found.select("digest", "license", "start", "m", dice.alias("dice")).where(F.col("dice") * 100 >= percent)
    best = scored.groupBy("digest", "license", "start").agg(F.max(F.struct("dice", F.col("m").alias("words"))).alias("best"))
    best = common.staged(best.select("digest", "start", "license", "best.words", "best.dice"), "license-matches", paths)
    # matches meet in the stretches that they touch; a stretch is as long as the longest match, so its matches are bounded
    touched = best.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("start") + F.col("words") - 1) / reach))))
    other = touched.select("digest", "stretch", *(F.col(c).alias(f"o_{c}") for c in ("start", "license", "words", "dice")))
    overlap = (F.col("o_start") < F.col("start") + F.col("words")) & (F.col("start") < F.col("o_start") + F.col("o_words"))
    rank = lambda c: F.struct(-F.col(f"{c}dice"), -F.col(f"{c}words"), F.col(f"{c}license"), F.col(f"{c}start"))
    worse = touched.join(other, ["digest", "stretch"]).where(overlap & (rank("o_") < rank(""))).select("digest", "license", "start").distinct()
    kept = best.join(worse, ["digest", "license", "start"], "left_anti")
    # as long as a text has matching windows
    return kept.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "license", "words", "dice"))).alias("matches"))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_matches, licenses, best_dice, matches) of every row; licenses is a sorted, comma-joined list."""
    common.session(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    left: list[str] = []
    per = common.staged(matches(rows.select("digest", "text"), templates or TEMPLATES, percent, left), "licenses")
    common.drop(docs.sparkSession, *left)
    out = rows.select("doc_id", "digest").join(per, "digest", "left")
    out = out.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<start:int,license:string,words:int,dice:double>>")))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"), "matches")
