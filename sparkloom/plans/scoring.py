"""The composite score of a candidate: scene, audio, text and layout evidence, and what counts against it.

Missing evidence scores zero; sums over text frames are divided by the fixed number of frames that are expected, not by
those that were read. The constants are fixed values of the score's definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..functions.udfs import normalize_text
from ..operators.features import clamp, gain_quality, rect_area

#: Threshold, expected frames, and what is read of a frame (fixed values).
THRESHOLD = 55.0
FRAMES = 3
MOST_CHARACTERS, MOST_WORDS, MOST_RUNS, MOST_LETTERS, MOST_OBSERVATIONS = 512, 64, 128, 40, 64
SEAM_FLOOR, CUT_SCALE, JOIN_FLOOR = 1 / 255, 4 / 255, 2 / 255
#: Host names within a text (fixed value).
DOMAIN = r"(?<![a-z0-9.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}(?![a-z0-9.-])"
#: Words that speak for promotion and for the programme itself (fixed values).
LEXICON = {
    "promotion": ["register", "registration", "deposit", "bonus", "casino", "slot", "slots", "gambling", "game", "games", "betting", "bet", "rebate", "signup"],
    "promotion_han": ["注册", "註冊", "充值", "投注", "博彩", "棋牌", "奖金", "獎金", "中奖", "中獎", "大奖", "大獎", "娱乐城", "遊戲", "游戏"],
    "programme": ["cast", "elenco", "traducao", "dublagem", "starring", "screenplay"],
    "programme_han": ["配音", "演員", "演员", "字幕製作", "字幕制作"],
}


def scene_points(joined: Column, start: Column, end: Column, natives: list[Column], contexts: Column) -> Column:
    """0 to 40; zero if a seam is missing or not within 0 and 1, or the contexts are not usable.

    ``natives`` are the baselines of both sides; those that are not within 0 and 1 do not count.
    """
    seam = F.least(start, end)
    strength = clamp(1 - joined / F.greatest(seam, F.lit(SEAM_FLOOR)))
    contrast = clamp(seam / CUT_SCALE)
    base = F.coalesce(F.array_max(F.array(*(F.when(n.between(0, 1), n) for n in natives))), F.lit(0.0))
    temporal = clamp(base / SEAM_FLOOR) / (1 + joined / F.greatest(4 * base, F.lit(JOIN_FLOOR)))
    known = joined.between(0, 1) & start.between(0, 1) & end.between(0, 1) & contexts
    return F.when(known, 20 * strength * contrast + 5 * contrast + 15 * temporal * contrast).otherwise(0.0)


def audio_points(candidate_rms: Column, candidate_peak: Column, sides: list[tuple[Column, Column]]) -> Column:
    """0 to 25: the mean over the sides that can be measured."""
    found = F.array_compact(F.array(*(gain_quality(candidate_rms, candidate_peak, r, p) for r, p in sides)))
    return F.when(F.size(found) > 0, 25 * F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found)).otherwise(0.0)


def lexicon_quality(text: Column, family: str) -> Column:
    """The best fuzzy match of a family's words, from 0 at a similarity of a half to 1."""
    words = F.slice(F.filter(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) <= MOST_LETTERS), 1, MOST_WORDS)
    terms = lambda name: F.array(*map(F.lit, LEXICON[name]))
    runs = F.regexp_extract_all(text, F.lit(r"[\x{3400}-\x{9fff}]+"), F.lit(0))

    def pieces(run: Column, n: Column) -> Column:
        many = F.length(run) - n + 1
        return F.when(many > 0, F.transform(F.sequence(F.lit(1), many), lambda i: F.substr(run, i, n))).otherwise(F.array().cast("array<string>"))

    def around(term: Column) -> Column:
        sizes = F.sequence(F.greatest(F.lit(1), F.length(term) - 1), F.length(term) + 1)
        return F.slice(F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(sizes, lambda n: pieces(r, n))))), 1, MOST_RUNS)

    best = lambda found: F.coalesce(F.array_max(found), F.lit(0.0))
    latin = F.flatten(F.transform(terms(family), lambda t: F.transform(words, lambda w: similarity(w, t))))
    han = F.flatten(F.transform(terms(f"{family}_han"), lambda t: F.transform(around(t), lambda w: similarity(w, t))))
    return clamp((F.greatest(best(latin), best(han)) - 0.5) / 0.5)


def unit_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The part of a box within the unit image as struct<x0, y0, x1, y1>; null if there is none."""
    box = [F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0)), F.least(x + width, F.lit(1.0)), F.least(y + height, F.lit(1.0))]
    return F.when((width > 0) & (height > 0) & (box[2] > box[0]) & (box[3] > box[1]), F.struct(*(b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True))))


def frame_observations(observations: DataFrame, id_: str = "id") -> DataFrame:
    """AUX-06: what is read of each frame (id, time): its first observations by ``nth``, without those that say nothing.

    Of (nth, text, confidence, x, y, width, height) the first 64 of a frame are looked at; a missing text, a confidence that is not
    within 0 and 1 and a blank text drop out. Adds ``q``, the normalised text, ``box``, the part within the image, and ``missing`` for a
    box that has none. Without a column ``nth`` all are looked at.
    """
    o = observations
    if "nth" in o.columns:
        o = o.withColumn("at", F.row_number().over(W.partitionBy(id_, "time").orderBy("nth"))).where(F.col("at") <= MOST_OBSERVATIONS).drop("at")
    o = o.where("text IS NOT NULL AND confidence BETWEEN 0 AND 1").withColumns({"q": F.sqrt("confidence"), "text": normalize_text(F.substring("text", 1, MOST_CHARACTERS)), "n": F.monotonically_increasing_id()})
    o = o.where(F.trim("text") != "").withColumn("box", unit_box(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    return o.withColumn("missing", F.when(F.col("box").isNull(), "missing_or_invalid_unit_image_geometry"))


def text_frames(observations: DataFrame, outside: DataFrame, id_: str = "id") -> DataFrame:
    """(id, time, domain, semantic, programme, p, large, edge, invalid) of each frame of (id, time, text, confidence, x, y, width, height).

    ``outside`` holds (id, domain, quality) of domains that the neighbouring programme shows: they count half as new. ``invalid``
    counts the observations whose box is not within the image.
    """
    o = frame_observations(observations, id_)
    o = o.withColumns({"domains": F.array_distinct(F.regexp_extract_all("text", F.lit(DOMAIN), F.lit(0))), "promo": lexicon_quality(F.col("text"), "promotion"), "show": lexicon_quality(F.col("text"), "programme")})
    # what an observation says costs much more than the rest, so it is made once: a frame's few observations go into arrays, not into joins
    known = outside.groupBy(id_, "domain").agg(F.max("quality").alias("seen")).groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("domain", "seen"))).alias("seen"))
    area = lambda a, b, c, d: F.greatest(c - a, F.lit(0.0)) * F.greatest(d - b, F.lit(0.0))
    b = {n: F.col(f"box.{n}") for n in ("x0", "y0", "x1", "y1")}
    middle = area(F.greatest(b["x0"], F.lit(0.2)), F.greatest(b["y0"], F.lit(0.25)), F.least(b["x1"], F.lit(0.8)), F.least(b["y1"], F.lit(0.75)))
    # clamp() passes over nulls, so a box without a place is asked for first
    large = F.when(F.col("box").isNotNull(), F.col("q") * clamp((b["y1"] - b["y0"]) / 0.12) * clamp(F.try_divide(middle, area(*b.values()))))
    weight = F.col("q") * F.greatest((F.size("domains") > 0).cast("double"), F.col("promo") * F.col("promo"))
    frames = o.groupBy(id_, "time").agg(
        F.max(F.col("q") * F.col("promo")).alias("semantic"),
        F.max(F.col("q") * F.col("show")).alias("programme"),
        F.coalesce(F.max(large), F.lit(0.0)).alias("large"),
        F.count("missing").alias("invalid"),
        F.collect_list(F.when(F.size("domains") > 0, F.struct("q", "domains"))).alias("named"),
        F.collect_list(F.when(F.col("box").isNotNull(), F.struct(*(c.alias(n) for n, c in b.items()), weight.alias("weight")))).alias("rects"),
    )
    frames = frames.join(known, id_, "left")
    fresh = F.flatten(F.transform("named", lambda x: F.transform(x["domains"], lambda d: x["q"] * (1 - 0.5 * F.coalesce(F.try_element_at("seen", d), F.lit(0.0))))))
    edges = rect_area(F.transform("rects", lambda r: r.withField("y1", F.least(r["y1"], F.lit(0.2))))) + rect_area(F.transform("rects", lambda r: r.withField("y0", F.greatest(r["y0"], F.lit(0.8)))))
    edge = clamp(F.coalesce(F.try_divide(edges, rect_area(F.col("rects"))), F.lit(0.0)))
    frames = frames.select(id_, "time", "semantic", "programme", "large", "invalid", F.coalesce(F.array_max(fresh), F.lit(0.0)).alias("domain"), edge.alias("edge"))
    return frames.withColumn("p", 0.65 * F.col("domain") + 0.35 * F.col("semantic"))


def score(cases: DataFrame, frames: DataFrame, id_: str = "id") -> DataFrame:
    """(id, s, a, p, c, o, programme, score, decision, invalid) of cases with columns s, a and valid."""
    mean = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / FRAMES
    text = frames.groupBy(id_).agg(mean("domain").alias("domain"), mean("semantic").alias("semantic"), mean("programme").alias("programme"), mean("large").alias("large"), mean(20 * F.col("p") * F.col("edge") * (1 - F.col("large"))).alias("o"), F.sum("invalid").alias("invalid"))
    out = cases.join(text, id_, "left").na.fill(0.0, ["domain", "semantic", "programme", "large", "o", "invalid"])
    out = out.withColumn("p", 25 * (0.65 * clamp(F.col("domain")) + 0.35 * clamp(F.col("semantic")))).withColumn("programme", 40 * clamp(F.col("programme")))
    out = out.withColumn("c", F.least(F.lit(60.0), F.col("p") + 50 * F.col("large")))
    out = out.withColumn("score", 100 * clamp((F.col("s") + F.col("a") + F.col("c") - F.col("o") - F.col("programme")) / 100))
    decision = F.when(F.col("valid") & (F.col("score") >= THRESHOLD), "candidate").otherwise("unknown")
    return out.select(id_, "s", "a", "p", "c", "o", "programme", "score", decision.alias("decision"), "invalid")


def cannot_pass(s: Column, a: Column, frames: int, margin: float = 0.0) -> Column:
    """Whether no text could lift a case to the threshold: text recognition is then not worth its cost."""
    most = min(60.0, 25.0 * frames / FRAMES + 50.0 * frames / FRAMES)
    return s + a + most + margin < THRESHOLD


def outcome(truth: Column, valid: Column, selected: Column) -> Column:
    """How a decision compares with the truth."""
    return F.when(truth != "ad", F.when(selected, "false_positive").otherwise("preserved")).otherwise(F.when(~valid, "unknown").when(selected, "full_hit").otherwise("missed"))
