"""File kinds: media types, extensions, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import lookup

# Canonical extension by media type.
MEDIA = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.ms-excel": "xls",
    "text/plain": "txt",
    "text/markdown": "md",
    "text/csv": "csv",
    "text/html": "html",
    "application/rtf": "rtf",
    "text/rtf": "rtf",
    "application/epub+zip": "epub",
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/bmp": "bmp",
    "image/tiff": "tiff",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "audio/mpeg": "mp3",
    "audio/mp3": "mp3",
    "audio/wav": "wav",
    "audio/x-wav": "wav",
    "audio/mp4": "m4a",
    "audio/x-m4a": "m4a",
    "audio/aac": "aac",
    "audio/x-aac": "aac",
    "audio/ogg": "ogg",
    "audio/flac": "flac",
    "audio/x-flac": "flac",
    "audio/webm": "webm",
    "video/mp4": "mp4",
    "video/mpeg": "mpeg",
    "video/avi": "avi",
    "video/x-msvideo": "avi",
    "video/quicktime": "mov",
    "video/x-matroska": "mkv",
    "video/mkv": "mkv",
    "video/webm": "webm",
    "video/x-ms-wmv": "wmv",
    "video/3gpp": "3gp",
    "message/rfc822": "eml",
    "application/vnd.ms-outlook": "msg",
}
# Extensions that have another canonical form.
ALIASES = {"htm": "html", "jpeg": "jpg", "tif": "tiff", "mpg": "mpeg"}
# Extensions of images, sound and films.
IMAGES = ("jpg", "png", "gif", "bmp", "tiff", "webp", "svg")
AUDIO = ("mp3", "wav", "m4a", "aac", "ogg", "flac")
VIDEO = ("mp4", "avi", "mov", "mkv", "webm", "wmv", "mpeg", "3gp")


def extension(path: Column) -> Column:
    """Canonical extension of a path or address; null if unknown."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    ext = F.coalesce(lookup(ext, ALIASES), ext)
    return F.when(ext.isin(*sorted(set(MEDIA.values()))), ext)


def of_media(mime: Column) -> Column:
    return lookup(F.lower(F.regexp_replace(mime, r"\s*;.*$", "")), MEDIA)


def magic(content: Column) -> Column:
    """Extension by the first bytes; null if they say nothing."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(head.startswith("664C6143"), "flac").when(head.startswith("4F676753"), "ogg").when(head.startswith("494433"), "mp3").when(head.startswith("7B5C727466"), "rtf").when(head.startswith("1A45DFA3"), "mkv")
    )


def detected(path: Column, content: Column | None = None, mime: Column | None = None) -> Column:
    """Media type first, then the bytes, then the name."""
    found = [of_media(mime)] if mime is not None else []
    found += [magic(content)] if content is not None else []
    return F.coalesce(*found, extension(path))


def category(ext: Column) -> Column:
    """Image, audio, video or document."""
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video").when(ext.isNotNull(), "document")


def supported(spark: SparkSession) -> DataFrame:
    """Media types with extension and category."""
    rows = spark.createDataFrame(list(MEDIA.items()), "mime string, ext string")
    return rows.withColumn("category", category(F.col("ext")))
