"""Snapshots of product pages, and choices among the formats, captions and files of one item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, text
from .pages import address

# Where pictures and films are kept, limits of a snapshot, and orders of preference
IMAGE_BASE, IMAGE_HOSTS, FILM_HOSTS = "https://down-tw.img.susercontent.com/file/", ".img.susercontent.com", ".vod.susercontent.com"
MOST_IMAGES, MOST_VIDEOS, MOST_FORMATS = 50, 8, 64
CAPTIONS = ("zh-hant", "zh-tw", "zh-hk", "zh", "zh-hans", "zh-cn", "en", "ja", "ko")
AUDIO = ("mp3", "m4a", "aac", "opus", "ogg", "wav", "flac")
IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "bmp")
UNFINISHED = ("part", "ytdl", "tmp", "temp")

FORMAT = "struct<url:string,width:int,height:int,size:string,codec:string>"
SNAPSHOT = f"struct<documentUrl:string,documentMatches:boolean,found:boolean,shopId:string,itemId:string,gallerySourceCount:int,galleryComplete:boolean,imageHashes:array<string>,itemHasVideo:boolean,videoSourceCount:int,videos:array<struct<durationSeconds:bigint,thumbnail:string,formats:array<{FORMAT}>>>>"


def codec_rank(codec: Column) -> Column:
    """H.264 before what names no codec, that before HEVC."""
    name = F.replace(F.upper(F.coalesce(codec, F.lit(""))), F.lit("."), F.lit(""))
    return F.when(name.isin("H264", "AVC", "AVC1"), 2).when(name.isin("H265", "HEVC", "HEV1", "HVC1"), 0).otherwise(1)


def best_video(formats: Column) -> Column:
    """SRT-06: of formats (url, width, height, size, codec) the one of the best codec, then of the largest area, then the highest; the first of equals."""
    size = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    ranked = F.transform(formats, lambda f, i: F.struct(codec_rank(f["codec"]).alias("r"), (size(f["width"]) * size(f["height"])).alias("a"), F.coalesce(f["height"], F.lit(0)).alias("h"), (-i).alias("i")))
    return text.let(F.array_max(ranked), lambda best: F.get(formats, -best["i"]))


def caption_file(names: Column) -> Column:
    """SRT-07: of file names the first ``.vtt`` in the order of languages, a region counts as its language; others come after those, nameless ones last."""
    captions = F.filter(names, lambda n: F.rlike(n, F.lit(r"(?i)\.vtt$")))

    def rank(name: Column) -> Column:
        stem = F.regexp_replace(name, r"\.vtt$", "")
        lang = F.lower(F.when(F.contains(stem, F.lit(".")), F.substring_index(stem, ".", -1)).otherwise(""))
        place = F.lit(len(CAPTIONS))
        for i, known in reversed(list(enumerate(CAPTIONS))):
            place = F.when((lang == known) | F.startswith(lang, F.lit(f"{known}-")), i).otherwise(place)
        return F.when(F.trim(lang) == "", 1 << 30).otherwise(place)

    ranked = F.transform(captions, lambda n, i: F.struct(rank(n).alias("r"), i.alias("i")))
    return text.let(F.array_min(ranked), lambda best: F.get(captions, best["i"]))


def output_file(files: Column, kind: Column, wanted: Column) -> Column:
    """SRT-09: of files (name, size) the one to publish: for AUDIO and IMAGE the first of a fitting extension, else the largest.

    Only finished files named ``media.`` count, and no fragments. ``wanted``: the extension asked for as audio, which comes first.
    """
    ending = lambda f: F.lower(F.when(F.contains(f["name"], F.lit(".")), F.substring_index(f["name"], ".", -1)).otherwise(""))
    good = F.filter(files, lambda f: F.startswith(f["name"], F.lit("media.")) & ~F.contains(f["name"], F.lit("-Frag")) & ~ending(f).isin(*UNFINISHED))

    def choose(x: Column) -> Column:
        first = lambda test: F.get(F.filter(x, test), F.lit(0))
        largest = text.let(F.array_max(F.transform(x, lambda f, i: F.struct(f["size"].alias("s"), (-i).alias("i")))), lambda best: F.get(x, -best["i"]))
        audio = F.coalesce(first(lambda f: ending(f) == F.lower(wanted)), first(lambda f: ending(f).isin(*AUDIO)))
        picked = F.when(kind == "AUDIO", audio).when(kind == "IMAGE", first(lambda f: ending(f).isin(*IMAGES)))
        return F.coalesce(picked, largest)["name"]

    return text.let(good, choose)


def product_media(snapshots: DataFrame, key: str, json: str, shop: str, item: str) -> DataFrame:
    """SRC-12, (key, place, name, url, image, seconds, height, bytes): the films and then the pictures of a product's snapshot.

    A snapshot that is not whole gives nothing: fields of the wrong kind or missing, of another product, an unfinished gallery, counts
    that differ, a picture that is no hash, a film without formats or with one that is no MP4 on the right hosts.
    """
    of = lambda field: F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{field}", "variant")) == "STRING"
    rows = snapshots.select(F.col(key).alias("key"), F.col(shop).alias("shop"), F.col(item).alias("item"), F.from_json(json, SNAPSHOT).alias("s"), F.try_parse_json(json).alias("v"))
    s = F.col("s")
    at = address(s["documentUrl"])
    images, videos = s["imageHashes"], s["videos"]
    sound = lambda f: F.coalesce(checks.cdn_url(f["url"], FILM_HOSTS, r"(?i:\.mp4)"), F.lit(False))
    films = F.forall(videos, lambda v: F.coalesce(F.size(v["formats"]).between(1, MOST_FORMATS) & F.forall(v["formats"], sound), F.lit(False)))
    whole = s["documentMatches"] & s["found"] & s["galleryComplete"] & of("documentUrl") & of("shopId") & of("itemId")
    whole &= (at["kind"] == "product") & (at["line"] == F.col("shop")) & (at["id"] == F.col("item")) & (s["shopId"] == F.col("shop")) & (s["itemId"] == F.col("item"))
    whole &= F.size(images).between(1, MOST_IMAGES) & (s["gallerySourceCount"] == F.size(images)) & F.forall(images, lambda h: F.coalesce(F.rlike(h, F.lit(r"^[A-Za-z0-9_-]{1,200}\z")), F.lit(False)))
    whole &= F.size(videos).between(0, MOST_VIDEOS) & (s["videoSourceCount"] == F.size(videos)) & (~s["itemHasVideo"] | (F.size(videos) > 0)) & films
    good = rows.where(F.coalesce(whole, F.lit(False)))
    product = F.concat(F.col("shop"), F.lit("_"), F.col("item"), F.lit("_"))
    positive = lambda c: F.when(c > 0, c)

    def film(v: Column, i: Column) -> Column:
        picture = checks.thumbnail(v["thumbnail"], IMAGE_BASE, IMAGE_HOSTS)
        return text.let(best_video(v["formats"]), lambda b: F.struct(F.concat(F.lit("ShopeeVideo_"), product, (i + 1).cast("string")).alias("name"), b["url"].alias("url"), picture.alias("image"), positive(v["durationSeconds"]).alias("seconds"), positive(b["height"]).alias("height"), positive(b["size"].try_cast("bigint")).alias("bytes")))

    def picture(h: Column, i: Column) -> Column:
        url, none = F.concat(F.lit(IMAGE_BASE), h), F.lit(None)
        return F.struct(F.concat(F.lit("ShopeeImage_"), product, (i + 1).cast("string")).alias("name"), url.alias("url"), url.alias("image"), none.cast("bigint").alias("seconds"), none.cast("int").alias("height"), none.cast("bigint").alias("bytes"))

    return good.select("key", F.posexplode(F.concat(F.transform(videos, film), F.transform(images, picture))).alias("place", "m")).select("key", "place", "m.*")
