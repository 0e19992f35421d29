"""Checks and choices over single rows, as built-in expressions: cached files, plans, sessions, sources and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.manifests import http_url

HEX = r"^[0-9a-f]{64}$"
#: Bytes that a cached segment may have, groups that a plan may skip, minutes that a session may last (fixed values).
MOST_BYTES = 32 << 20
MOST_GROUPS = 4096
MINUTES = (5, 10, 15, 20, 25, 30, 60)


def no(x: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(x, F.lit(False))


def file_matches(content: Column, size: Column, sha256: Column) -> Column:
    """Whether bytes have a size and a digest, given in any case."""
    return no((F.octet_length(content) == size) & (F.sha2(content, 256) == F.lower(sha256)))


def cache_state(url: Column, size: Column, sha256: Column, path: Column, content: Column) -> Column:
    """valid, stale (bytes are gone or others) or refused (the entry itself cannot be) for a cached segment."""
    place = F.concat(F.lit("ad-cache/"), F.sha2(url.cast("binary"), 256), F.lit(".ts"))
    sound = http_url(url) & size.between(1, MOST_BYTES) & F.rlike(sha256, F.lit(HEX)) & (path == place)
    return F.when(~no(sound), "refused").when(file_matches(content, size, sha256), "valid").otherwise("stale")


def assets_intact(expected: DataFrame, actual: DataFrame, policy: str, required: list[str]) -> DataFrame:
    """(policy, intact): whether every required asset is named, and every named one (name, sha256) has these bytes (name, content)."""
    found = expected.join(actual.select("name", F.sha2("content", 256).alias("_sha")), "name", "left")
    plain = ~F.contains("name", F.lit("/")) & F.rlike("sha256", F.lit(HEX)) & (F.col("sha256") == F.col("_sha"))
    named = F.count_distinct(F.when(F.col("name").isin(required), F.col("name")))
    return found.groupBy(policy).agg((F.bool_and(no(plain)) & (named == len(required))).alias("intact"))


def plan_holds(identity: Column, groups: Column, segments: Column, seconds: Column, manifest_ok: Column, unchanged: Column, most: int = MOST_GROUPS) -> Column:
    """Whether a plan's numbers agree: it skips something in every count, or nothing at all and leaves the playlist as it was."""
    finite = (seconds >= 0) & (seconds < float("inf"))
    some = (groups > 0) & (segments > 0) & (seconds > 0)
    none = (groups == 0) & (segments == 0) & (seconds == 0) & unchanged
    return no(F.rlike(identity, F.lit(HEX)) & manifest_ok & groups.between(0, most) & (segments >= 0) & finite & (some | none))


def session_valid(started: Column, expires: Column, boot: Column, now: Column, now_boot: Column) -> Column:
    """Whether a sharing session with a fixed deadline (milliseconds since boot) still holds."""
    length = (expires - started).isin([m * 60_000 for m in MINUTES])
    return no((boot >= 0) & (boot == now_boot) & (started >= 0) & (now >= started) & (now < expires) & length)


def transcript_source(status: Column, label: Column, mime: Column, output: Column, page: Column) -> Column:
    """struct<uri, is_page>: what to transcribe, a finished recording before its page; null where there is nothing."""
    image = no(label == "Image") | no(F.startswith(mime, F.lit("image/")))
    recorded = no((status == "COMPLETED") & output.isNotNull() & (F.startswith(mime, F.lit("video/")) | F.startswith(mime, F.lit("audio/"))))
    pair = lambda uri, is_page: F.struct(uri.alias("uri"), F.lit(is_page).alias("is_page"))
    web = no(F.rlike(page, F.lit(r"^https?://[^/?#@\s]+([/?#]\S*)?\z")))
    return F.when(image, None).when(recorded, pair(output, False)).when(web, pair(page, True))


def download_plan(target: Column, source: Column, index: Column, chosen: Column, formats: Column, headers: Column) -> Column:
    """struct<url, index, format, headers>: a page is extracted anew, a direct resource is fetched as it is.

    ``chosen`` is a format or null; formats have url, is_image and headers. Headers of the resource replace those of the
    item whatever their case.
    """
    same = F.filter(formats, lambda f: f["url"] == source)
    resource = F.coalesce(F.when(chosen.isNotNull() & chosen["url"].isNotNull(), chosen), F.get(same, 0))
    own = F.coalesce(resource["headers"], F.create_map().cast("map<string,string>"))
    lower = F.transform(F.map_keys(own), F.lower)
    merged = F.map_concat(F.map_filter(headers, lambda k, _: ~F.array_contains(lower, F.lower(k))), own)
    kind = F.when(chosen.isNull(), "as asked").when(chosen["is_image"], "image").otherwise("best video")
    page = F.struct(source.alias("url"), index.alias("index"), F.lit("as asked").alias("format"), headers.alias("headers"))
    direct = F.struct(F.coalesce(resource["url"], source).alias("url"), F.lit(None).cast("int").alias("index"), kind.alias("format"), merged.alias("headers"))
    return F.when(target == "PAGE", page).otherwise(direct)


def share_route(page: Column, items: Column, picker: Column, one_tap: Column, all_of_many: Column) -> Column:
    """What a shared link leads to: its page at once, an error, all items at once, or a choice."""
    at_once = one_tap & ((items == 1) | all_of_many)
    return F.when(~picker & page, "page").when(items == 0, "error").when(~picker & at_once, "submitted").otherwise("picker")


def select_all(line: Column, urls: Column) -> Column:
    """struct<line, urls> with every episode of a line; an empty line selects nothing."""
    return F.when(F.size(urls) > 0, F.struct(line.alias("line"), F.array_distinct(urls).alias("urls")))


def clear_line(selection: Column, line: Column) -> Column:
    """The selection without a line: it is gone if it was of that line."""
    return F.when(~no(selection["line"] == line), selection)


def moved_pause(rows: DataFrame, queue: str, position: str) -> DataFrame:
    """Pauses that only rows about to go still own move to the row that stays: columns active, terminal, deleted, pause.

    A row goes if it is deleted and not active, or ended while it waited for the network. The most severe pause of all rows goes to
    the first row left that has one, else to the first that has not ended.
    """
    severity = F.when(F.col("pause") == "NETWORK", 1).when(F.col("pause") == "SYSTEM", 2).when(F.col("pause") == "STORAGE", 3)
    goes = (F.col("deleted") & ~F.col("active")) | (F.col("terminal") & no(F.col("pause") == "NETWORK"))
    rows = rows.withColumns({"_goes": goes, "_severity": severity})
    first = lambda c: F.min(F.when(~F.col("_goes") & c, F.col(position)))
    w = W.partitionBy(queue)
    moving = F.max(F.when(F.col("_goes"), F.col("_severity"))).over(w).isNotNull()
    target = F.coalesce(first(F.col("pause").isNotNull()).over(w), first(~F.col("terminal")).over(w))
    worst = F.max_by("pause", "_severity").over(w)
    new = F.when(~moving, F.col("pause")).when(F.col("_goes"), None).when(F.col(position) == target, worst).otherwise(F.col("pause"))
    return rows.withColumn("new_pause", new).drop("_goes", "_severity")


def resumed_job(prior_engine: Column, engine: Column, windows: Column, text: Column) -> Column:
    """struct<start, text>: where a transcription goes on. Another engine, or no text so far, starts over."""
    anew = no(prior_engine != engine) | (F.trim(F.coalesce(text, F.lit(""))) == "")
    return F.struct(F.when(anew, 0).otherwise(F.greatest(windows, F.lit(0))).alias("start"), F.when(no(prior_engine != engine), "").otherwise(F.coalesce(text, F.lit(""))).alias("text"))


def audio_arguments(source: Column, output: Column, start: Column, end: Column, rate: int = 16000, most_minutes: int = 10) -> Column:
    """Arguments that cut one range (milliseconds) of a recording to PCM; null where the range or the files cannot be.

    A null end means to the end, with a bound on the bytes.
    """
    seconds = lambda ms: F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    lits = lambda text: F.array(*map(F.lit, text.split()))
    most = str(rate * 60 * most_minutes * 2 + 1)
    length = F.when(end.isNull(), F.array(F.lit("-fs"), F.lit(most))).otherwise(F.array(F.lit("-t"), seconds(end - start)))
    whole = F.concat(
        lits("-nostdin -hide_banner -loglevel error -xerror -y -protocol_whitelist file -threads 2 -ss"),
        F.array(seconds(start)),
        lits("-accurate_seek -i"),
        F.array(source),
        length,
        lits(f"-map 0:a:0 -vn -sn -dn -threads 2 -ac 1 -ar {rate} -c:a pcm_s16le -f s16le"),
        F.array(output),
    )
    return F.when((start >= 0) & (end.isNull() | (end > start)) & (source != output), whole)


def decoded(primary: Column, fallback: Column) -> Column:
    """Samples of the first decoder, or of the second where the first failed (null) or found none."""
    return F.when(no(F.size(primary) > 0), primary).otherwise(fallback)


def cdn_url(url: Column, suffix: str, end: str = "") -> Column:
    """Whether this is a plain https URL with a path on a host with this suffix."""
    host = suffix.replace(".", r"\.")
    return no((F.length(url) <= 4096) & F.rlike(url, F.lit(rf"^(?i:https)://[^/?#@:\s]*(?i:{host})(:443)?/[^?#\s]*{end}(\?[^#\s]*)?(#\S*)?\z")))


def thumbnail(value: Column, base: str, suffix: str) -> Column:
    """A picture's URL from its hash or, where it is on the right host, as it stands."""
    return F.when(F.rlike(value, F.lit(r"^[A-Za-z0-9_-]{1,200}\z")), F.concat(F.lit(base), value)).when(cdn_url(value, suffix), value)


def reel_url(link: Column) -> Column:
    """The reel that a link names, also behind a redirect page; null if none."""
    hidden = F.try_url_decode(F.regexp_extract(link, r"(?i)[?&]u=([^&]+)", 1))
    target = F.when(F.rlike(link, F.lit(r"(?i)^https://l\.facebook\.com/l\.php\?")), hidden).otherwise(link)
    code = F.regexp_extract(target, r"(?i)^https?://(?:www\.)?instagram\.com/(?:reel|reels)/([A-Za-z0-9_-]+)", 1)
    return F.when(no(code != ""), F.concat(F.lit("https://www.instagram.com/reel/"), code, F.lit("/")))


def static_asset(url: Column) -> Column:
    """Whether a URL is a part of a page's own dress: on a static host, or a bundled resource."""
    host = F.lower(F.regexp_extract(url, r"^[^/]*://([^/]*)", 1))
    return F.startswith(host, F.lit("static.")) | F.contains(url, F.lit("/rsrc.php"))


def video_name(code: Column, index: Column, count: Column) -> Column:
    return F.concat(F.lit("ThreadsVideo_"), code, F.when(count > 1, F.concat(F.lit("_"), (index + 1).cast("string"))).otherwise(F.lit("")))


def queue_record(payload: Column, schema: str, id_: Column, position: Column) -> Column:
    """A stored record if its payload says the same id and position as its key columns, else null."""
    record = F.from_json(payload, schema)
    return F.when(no((record["id"] == id_) & (record["position"] == position)), record)


def stored_list(text: Column, schema: str) -> Column:
    """The items of a list kept as JSON under one key; what cannot be read is an empty list."""
    return F.coalesce(F.filter(F.from_json(text, f"array<struct<{schema}>>"), lambda x: x.isNotNull()), F.from_json(F.lit("[]"), f"array<struct<{schema}>>"))


def pcm_samples(content: Column, most: int) -> Column:
    """Floats of little-endian 16-bit samples; null if bytes are odd or there are more than ``most`` samples."""
    n = F.octet_length(content)
    whole = F.hex(content)
    byte = lambda i, j: F.conv(F.substring(whole, 4 * i + 2 * j + 1, 2), 16, 10).cast("int")
    value = lambda i: byte(i, 0) + 256 * byte(i, 1)
    signed = lambda i: F.when(value(i) >= 32768, value(i) - 65536).otherwise(value(i))
    at = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), F.floor(n / 2) - 1))
    return F.when((n % 2 == 0) & (n <= 2 * most), F.transform(at, lambda i: signed(i.cast("int")) / F.lit(32768.0)))


def mono(samples: Column, channels: Column) -> Column:
    """The mean of the channels of interleaved samples; what is left of a frame at the end goes."""
    n = F.greatest(channels, F.lit(1))
    frames = F.floor(F.size(samples) / n).cast("int")
    mean = lambda i: F.aggregate(F.slice(samples, i * n + 1, n), F.lit(0.0), lambda a, x: a + x) / n
    return F.when(frames == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), frames - 1), mean))


def resampled(samples: Column, rate: Column, target: int = 16000) -> Column:
    """Samples at another rate, by linear interpolation between neighbours."""
    ratio = F.lit(float(target)) / rate
    size = F.size(samples)
    n = F.greatest(F.floor(size * ratio), F.lit(1)).cast("int")
    at = lambda i: F.get(samples, F.least(i, size - 1))

    def one(i: Column) -> Column:
        place = i / ratio
        first = F.floor(place).cast("int")
        part = place - first
        return at(first) * (1 - part) + at(first + 1) * part

    return F.when((rate <= 0) | (rate == target) | (size == 0), samples).otherwise(F.transform(F.sequence(F.lit(0), n - 1), one))
