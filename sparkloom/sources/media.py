"""Parsers of media metadata: info JSON, progress lines, recognised words, download choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions of images, and MIME types by extension (fixed values).
IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "bmp")
MIME = {
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "webm": "video/webm",
    "mkv": "video/x-matroska",
    "mov": "video/quicktime",
    "3gp": "video/3gpp",
    "ts": "video/mp2t",
    "mp3": "audio/mpeg",
    "m4a": "audio/mp4",
    "aac": "audio/aac",
    "opus": "audio/opus",
    "ogg": "audio/ogg",
    "wav": "audio/wav",
    "flac": "audio/flac",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "gif": "image/gif",
    "heic": "image/heic",
    "heif": "image/heic",
    "bmp": "image/bmp",
}

FORMAT = "struct<format_id:string,ext:string,vcodec:string,acodec:string,height:int,filesize:bigint,filesize_approx:bigint,url:string>"
ENTRY = f"id:string,title:string,ext:string,thumbnail:string,duration:double,webpage_url:string,url:string,series:string,season_number:int,episode_number:int,formats:array<{FORMAT}>"
INFO = f"struct<{ENTRY},extractor_key:string,entries:array<struct<{ENTRY}>>>"


def extension(url: Column) -> Column:
    """Lower-case file extension of a URL's path, or an empty string."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def mime_type(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("application/octet-stream"))


def image_kind(content: Column) -> Column:
    """Image type told from the first bytes of a file; null if it is none."""
    head = F.hex(F.substring(content, 1, 12))
    riff = F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")) & (F.length(head) == 24)
    kinds = (("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("47494638", "gif"), ("424D", "bmp"))
    out = F.when(riff, "webp")
    for magic, name in kinds:
        out = out.when(F.startswith(head, F.lit(magic)), name)
    return out


def media_formats(formats: Column) -> Column:
    """Usable formats with their labels: a row without an id, and one that is no image, video or audio, is dropped."""
    has = lambda codec: codec.isNotNull() & (codec != "none")

    def one(f: Column) -> Column:
        ext = F.lower(F.coalesce(f["ext"], F.lit("")))
        image, video, audio = ext.isin(*IMAGES), has(f["vcodec"]), has(f["acodec"])
        alone = F.when(audio, "").otherwise(" (video only)")
        label = (
            F.when(image, F.concat(F.lit("Image "), F.upper(ext)))
            .when(video & f["height"].isNotNull(), F.concat(f["height"].cast("string"), F.lit("p "), ext, alone))
            .when(video, F.concat(F.lit("Video "), ext, alone))
            .otherwise(F.concat(F.lit("Audio "), ext))
        )
        return F.struct(f["format_id"].alias("format_id"), F.when(ext == "", "bin").otherwise(ext).alias("ext"), label.alias("label"), f["height"].alias("height"), image.alias("image"), (video & ~image).alias("video"), (audio & ~image).alias("audio"), F.coalesce(f["filesize"], f["filesize_approx"]).alias("bytes"))

    made = F.transform(F.coalesce(formats, F.array().cast(f"array<{FORMAT}>")), one)
    return F.filter(made, lambda f: f["format_id"].isNotNull() & (f["image"] | f["video"] | f["audio"]))


def media_items(df: DataFrame, key: str, info: str) -> DataFrame:
    """(key, position, id, title, is_image, formats) of every item in an info JSON that offers something to download.

    A playlist gives its entries, numbered from 1; anything else gives itself, with no position. Media formats come
    before images, and these before a single format made from a direct URL.
    """
    parsed = df.select(key, F.from_json(info, INFO).alias("i"))
    listed = F.coalesce(F.size("i.entries"), F.lit(0)) > 0
    names = [c.split(":")[0] for c in ENTRY.split(",") if ":" in c and "<" not in c][:10]
    single = F.array(F.struct(*(F.col(f"i.{n}").alias(n) for n in names), F.col("i.formats").alias("formats")))
    entry = F.transform("i.entries", lambda e: F.when(e.isNotNull(), F.struct(*(e[n].alias(n) for n in names), e["formats"].alias("formats"))))
    rows = parsed.select(key, listed.alias("listed"), F.posexplode(F.when(listed, entry).otherwise(single)).alias("at", "e")).where("e IS NOT NULL")
    ext = F.lower(F.coalesce("e.ext", extension(F.col("e.url"))))
    image = ext.isin(*IMAGES)
    rows = rows.withColumn("all", media_formats(F.col("e.formats")))
    media, images = F.filter("all", lambda f: f["video"] | f["audio"]), F.filter("all", lambda f: f["image"])
    made = F.array(F.struct(F.lit("best").alias("format_id"), F.when(ext != "", ext).when(image, "jpg").otherwise("mp4").alias("ext"), F.when(image, "Image").otherwise("Video").alias("label"), F.lit(None).cast("int").alias("height"), image.alias("image"), (~image).alias("video"), (~image).alias("audio"), F.lit(None).cast("bigint").alias("bytes")))
    chosen = F.when(F.size(media) > 0, media).when(F.size(images) > 0, images).when(F.col("e.url").isNotNull(), made)
    is_image = F.when(F.size(media) > 0, F.lit(False)).when(F.size(images) > 0, F.lit(True)).otherwise(image)
    out = rows.select(key, F.when(F.col("listed"), F.col("at") + 1).alias("position"), F.coalesce("e.id", F.lit("")).alias("id"), F.coalesce("e.title", "e.id", F.lit("media")).alias("title"), is_image.alias("is_image"), chosen.alias("formats"))
    return out.where("formats IS NOT NULL")


def progress(line: Column, prefix: str = "progress:") -> Column:
    """struct<phase, fraction, downloaded, total> of a progress line; null if it reports nothing. -1: unknown fraction."""
    data = F.from_json(F.substr(F.trim(line), F.lit(len(prefix) + 1)), "struct<status:string,downloaded_bytes:bigint,total_bytes:bigint>")
    status = data["status"]
    known = lambda c, least: F.when(c >= least, c)
    done, total = known(data["downloaded_bytes"], 0), known(data["total_bytes"], 1)
    # least() skips nulls, so an unknown count is asked for first
    fraction = F.when(done.isNotNull() & total.isNotNull(), F.least(F.lit(1.0), done / total)).otherwise(F.lit(-1.0))
    phase = F.when(status == "finished", "PROCESSING").when(status == "downloading", "DOWNLOADING")
    loading = status == "downloading"
    return F.when(
        F.startswith(F.trim(line), F.lit(prefix)) & phase.isNotNull(),
        F.struct(phase.alias("phase"), F.when(loading, fraction).alias("fraction"), F.when(loading, done).alias("downloaded"), F.when(loading, total).alias("total")),
    )


def word_lines(words: DataFrame, keys: list[str], order: str, text: str, left: str, top: str, width: str, height: str, confidence: str) -> DataFrame:
    """Recognised words as lines: joined text, the box around them, and the least confidence; blanks and rejects go."""
    good = words.where((F.trim(text) != "") & (F.col(confidence) >= 0))
    right, bottom = F.max(F.col(left) + F.col(width)), F.max(F.col(top) + F.col(height))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda w: w[text]), " ")
    return good.groupBy(*keys).agg(line.alias("text"), F.min(left).alias("left"), F.min(top).alias("top"), (right - F.min(left)).alias("width"), (bottom - F.min(top)).alias("height"), F.min(confidence).alias("confidence"))


def format_arguments(kind: Column, height: Column, audio: Column, format_id: Column, has_audio: Column) -> Column:
    """Command-line arguments for a choice: IMAGE, BEST, CAPPED, AUDIO or FORMAT."""
    h = height.cast("string")
    capped = F.array(F.lit("-f"), F.concat(F.lit("bv*[height<="), h, F.lit("]+ba/b[height<="), h, F.lit("]/bv*+ba/b")), F.lit("-S"), F.concat(F.lit("res:"), h))
    own = F.array(F.lit("-f"), F.when(has_audio, format_id).otherwise(F.concat(format_id, F.lit("+ba/b"))))
    return (
        F.when(kind == "BEST", F.array(F.lit("-f"), F.lit("bv*+ba/b")))
        .when(kind == "CAPPED", capped)
        .when(kind == "AUDIO", F.array(F.lit("-x"), F.lit("--audio-format"), audio, F.lit("-f"), F.lit("ba/b")))
        .when(kind == "FORMAT", own)
        .otherwise(F.array().cast("array<string>"))
    )


def default_choice(is_image: Column, wants_audio: Column, cap: Column) -> Column:
    return F.when(is_image, "IMAGE").when(wants_audio, "AUDIO").when(cap.isNull(), "BEST").otherwise("CAPPED")


def rate(amount: Column, unit: Column) -> Column:
    """Bytes a second of a decimal amount and a unit size; null for fractions of a byte, zero, overflow and bad numbers."""
    plain = F.replace(F.trim(amount), F.lit(","), F.lit("."))
    number = F.when(F.rlike(plain, F.lit(r"^(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$")), F.rtrim(plain, F.lit("."))).try_cast("decimal(28,9)")
    total = F.try_multiply(number, unit.cast("decimal(10,0)"))
    return F.when((total > 0) & (total == F.floor(total)), total.try_cast("bigint"))


def language_code(code: Column) -> Column:
    """Two-letter code of a recogniser's language tag."""
    low = F.lower(F.regexp_replace(code, r"[<|>]", ""))
    return F.when(low.isin("yue", "cmn"), "zh").otherwise(F.left(low, F.lit(2)))
