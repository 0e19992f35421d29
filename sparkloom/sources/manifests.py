"""Playlists as text: rows for lines, segments and regions, why a playlist is refused, and playlists without some segments.

A playlist's lines are numbered as they stand in the text; blank ones count but say nothing. Whether a duration waits for
its URI is the last duration or URI line before, so one window over a playlist's lines decides every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import udfs

#: Tags that a plain playlist may hold, and the comment that marks an inserted segment (fixed values).
METADATA = ("#EXT-X-VERSION", "#EXT-X-TARGETDURATION", "#EXT-X-MEDIA-SEQUENCE", "#EXT-X-DISCONTINUITY-SEQUENCE", "#EXT-X-ALLOW-CACHE")
PLAIN = ("#EXT-X-INDEPENDENT-SEGMENTS", "#EXT-X-KEY:METHOD=NONE", "#EXT-X-PLAYLIST-TYPE:VOD")
MARKER = "# ppvod-ad-injected v1"

HEAD, END, BREAK, DURATION = "#EXTM3U", "#EXT-X-ENDLIST", "#EXT-X-DISCONTINUITY", "#EXTINF:"
#: Zero-width places after line ends.
LINE_ENDS = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
AUTHORITY = r"(?:[^/?#@:\[\]\s]+|\[[0-9A-Fa-f:.]+\])"


def http_url(url: Column) -> Column:
    """Whether this is an http(s) URL with a host, without user, fragment, blanks or controls, and not for port 0."""
    port = F.regexp_extract(url, rf"^[^:/?#]+://{AUTHORITY}:([0-9]+)", 1)
    plain = F.rlike(url, F.lit(rf"^(?i:https?)://{AUTHORITY}(:[0-9]*)?([/?][^#\s\p{{Z}}\x00-\x1f\x85]*)?\z"))
    return F.coalesce(plain & ((port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))), F.lit(False))


def _transport_stream(path: Column) -> Column:
    """Whether a path, percent escapes decoded, ends with .ts in any case."""
    return F.rlike(path, F.lit(r"(?:\.|%2[eE])(?:[tT]|%[57]4)(?:[sS]|%[57]3)$"))


def _reference(value: Column) -> Column:
    """Whether a URI line, relative or not, can name a plain segment."""
    path = F.regexp_replace(value, r"\?.*$", "")
    scheme = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    placed = F.when(scheme != "", http_url(value)).when(F.startswith(value, F.lit("//")), http_url(F.concat(F.lit("http:"), value))).otherwise(F.lit(True))
    return ~F.rlike(value, F.lit(r"[#\s\p{Z}\x00-\x1f]")) & placed & _transport_stream(path)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, value, ...): the lines that say something, trimmed, with what they are and what waits before them."""
    rows = df.select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("line", "raw")).withColumn("value", F.regexp_replace("raw", r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    rows = rows.where("value <> ''").drop("raw")
    v = F.col("value")
    kind = F.when(F.startswith(v, F.lit(DURATION)), "duration").when(v == END, "end").when(v == BREAK, "break").when(v == MARKER, "marker")
    kind = kind.when(v.isin(HEAD, *PLAIN) | F.substring_index(v, ":", 1).isin(*METADATA), "plain")
    kind = kind.when(F.startswith(v, F.lit("#EXT")) | F.startswith(v, F.lit("#ANVATO")) | F.startswith(v, F.lit("#UPLYNK")), "foreign")
    rows = rows.withColumn("kind", kind.when(F.startswith(v, F.lit("#")), "comment").otherwise("uri"))
    order = W.partitionBy(key).orderBy("line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    told = F.split(F.substring(v, 9, 1 << 30), ",", 2)[0]
    seconds = F.when(F.rlike(F.trim(told), F.lit(NUMBER)), F.trim(told).try_cast("double"))
    rows = rows.withColumn("seconds", F.when(F.col("kind") == "duration", F.when(seconds < float("inf"), seconds)))
    waits = F.coalesce(F.last(F.when(F.col("kind").isin("duration", "uri"), F.col("kind")), ignorenulls=True).over(before) == "duration", F.lit(False))
    return rows.withColumns({"waits": waits, "first": F.row_number().over(order) == 1, "last": F.lead("line").over(order).isNull(), "ended": F.coalesce(F.max(F.col("kind") == "end").over(before), F.lit(False))})


def checks(df: DataFrame, key: str, text: str, base: str) -> DataFrame:
    """(key, segments, fingerprint, parsed) of every playlist.

    ``segments`` is null where a download cannot be resumed from the playlist. ``fingerprint`` is the SHA-256 of a
    complete, plain one, else null. ``parsed`` tells whether it splits into regions.
    """
    rows = lines(df, key, text)
    kind, v = F.col("kind"), F.col("value")
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    is_ = lambda *k: kind.isin(*k)
    bad_time = is_("duration") & ~F.coalesce(F.col("seconds") > 0, F.lit(False))
    comma = is_("duration") & ~F.contains(v, F.lit(","))
    bad_uri = is_("uri") & (~F.col("waits") | ~_reference(v))
    head = any_(F.col("first") & (v != HEAD))
    again = any_(~F.col("first") & (v == HEAD))
    twice = any_(is_("duration") & F.col("waits"))
    left = any_(F.col("last") & (is_("duration") | F.col("waits") & ~is_("uri")))
    count = F.count_if(kind == "uri")
    ends = F.count_if(kind == "end")
    # where resuming is asked, keys and playlist types say more than one thing, and nothing plays after the end
    late = any_(F.col("ended") & is_("duration", "uri", "end"))
    other = any_(is_("foreign"))
    common = head | twice | left | any_(bad_time) | any_(bad_uri) | (count == 0) | any_(is_("end") & F.col("waits")) | other
    complete = any_(F.col("last") & is_("end"))
    resolved = udfs.resolve_url(F.lit(base), v)
    far = any_(is_("uri") & ~http_url(resolved))
    cut = any_(is_("break") & F.col("waits")) | (ends != 1) | far | any_(comma)
    found = rows.groupBy(key).agg(
        F.when(~common & ~late & (ends == 1), count).alias("segments"),
        F.coalesce(~common & complete & ~again, F.lit(False)).alias("whole"),
        F.coalesce(~common & complete & ~cut & ~again, F.lit(False)).alias("parsed"),
    )
    texts = df.select(F.col(key).alias("_key"), F.sha2(F.col(text).cast("binary"), 256).alias("_sha"))
    out = texts.join(found, texts["_key"] == found[key], "left")
    return out.select(F.col("_key").alias(key), "segments", F.when(F.col("whole"), F.col("_sha")).alias("fingerprint"), F.coalesce("parsed", F.lit(False)).alias("parsed"))


def segments(df: DataFrame, key: str, text: str, base: str) -> DataFrame:
    """(key, segment, region, seconds, url, marked, duration_line, line): segments of playlists that ``checks`` has parsed.

    ``marked``: an insertion marker stands between this segment and the one before it.
    """
    order = W.partitionBy(key).orderBy("line")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = lines(df, key, text).withColumns(
        {
            "region": F.coalesce(F.sum((F.col("kind") == "break").cast("int")).over(before), F.lit(0)).cast("long"),
            "seconds": F.last("seconds", ignorenulls=True).over(before),
            "duration_line": F.last(F.when(F.col("kind") == "duration", F.col("line")), ignorenulls=True).over(before),
            "marks": F.coalesce(F.sum((F.col("kind") == "marker").cast("int")).over(before), F.lit(0)),
        }
    )
    uris = rows.where("kind = 'uri'")
    marked = F.col("marks") > F.coalesce(F.lag("marks").over(order), F.lit(0))
    return uris.select(key, (F.row_number().over(order) - 1).cast("long").alias("segment"), "region", "seconds", udfs.resolve_url(F.lit(base), F.col("value")).alias("url"), marked.alias("marked"), "duration_line", "line")


def regions(df: DataFrame, key: str, text: str, segments_: DataFrame) -> DataFrame:
    """(key, region, start_boundary, end_boundary, seconds, segments, marked): every region, empty ones too."""
    n = lines(df, key, text).groupBy(key).agg(F.count_if(F.col("kind") == "break").alias("breaks"))
    every = n.select(F.col(key).alias("_key"), "breaks", F.explode(F.sequence(F.lit(0), F.col("breaks"))).alias("_region"))
    held = segments_.groupBy(key, "region").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("segments"), F.bool_or("marked").alias("marked"))
    out = every.join(held, (F.col("_key") == held[key]) & (F.col("_region") == held.region), "left")
    start = F.when(F.col("_region") == 0, "playlist_start").otherwise("discontinuity")
    end = F.when(F.col("_region") == F.col("breaks"), "playlist_end").otherwise("discontinuity")
    return out.select(F.col("_key").alias(key), F.col("_region").alias("region"), start.alias("start_boundary"), end.alias("end_boundary"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("marked", F.lit(False)).alias("marked"))


def without(df: DataFrame, key: str, text: str, removed: DataFrame) -> DataFrame:
    """(key, manifest): playlists without the duration and URI lines of ``removed`` segments; all else stays as it stands."""
    gone = removed.groupBy(key).agg(F.flatten(F.collect_list(F.array("duration_line", "line"))).alias("_gone"))
    rows = df.select(F.col(key).alias("_key"), F.split(text, LINE_ENDS).alias("_lines"))
    out = rows.join(gone, F.col("_key") == gone[key], "left")
    kept = F.filter("_lines", lambda x, i: ~F.coalesce(F.array_contains(F.col("_gone"), i), F.lit(False)))
    return out.select(F.col("_key").alias(key), F.array_join(kept, "").alias("manifest"))


RENDITION = r"[:,]\s*(?:AUDIO|VIDEO|SUBTITLES|CLOSED-CAPTIONS|URI)="


def single_variant(df: DataFrame, key: str, text: str, base: str) -> DataFrame:
    """(key, url): the one plain variant that a master playlist names, resolved, or null."""
    rows = lines(df, key, text)
    order = W.partitionBy(key).orderBy("line")
    v = F.col("value")
    stream = F.startswith(v, F.lit("#EXT-X-STREAM-INF:"))
    rows = rows.withColumns({"stream": stream, "wanted": F.coalesce(F.lag(stream).over(order), F.lit(False))}).withColumn("wanted", F.col("wanted") & ~F.col("first"))
    tame = F.startswith(v, F.lit("#EXT-X-VERSION:")) | (v == "#EXT-X-INDEPENDENT-SEGMENTS")
    bad = F.when(F.col("first"), v != HEAD).when(F.col("wanted"), F.startswith(v, F.lit("#"))).when(F.col("stream"), F.rlike(v, F.lit(RENDITION)) | F.col("last")).when(tame, False).otherwise(F.startswith(v, F.lit("#EXT")) | ~F.startswith(v, F.lit("#")))
    found = rows.groupBy(key).agg(F.bool_or(bad).alias("bad"), F.count_if("stream").alias("n"), F.max(F.when(F.col("wanted"), v)).alias("uri"))
    url = udfs.resolve_url(F.lit(base), F.col("uri"))
    return found.select(key, F.when(~F.col("bad") & (F.col("n") == 1) & http_url(url), url).alias("url"))
