"""What files a corpus has: kinds, roots, audio extensions, contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import schema as S
from subtide.functions.columns import strip

KINDS = (("video", S.VIDEO_SUFFIXES), ("audio", S.AUDIO_SUFFIXES), ("json", S.JSON_SUFFIXES), ("subtitle", S.SUBTITLE_SUFFIXES), ("text", S.TEXT_SUFFIXES), ("image", S.IMAGE_SUFFIXES))
URL_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"
#: The last part of a path after its last dot, if something stands before that.
SUFFIX_PATTERN = r"[^/](\.[^./]+)$"
STAGE_PATTERN = r"(?:" + "|".join(re.escape(x) for x in sorted(S.STAGE_SUFFIXES, key=len, reverse=True)) + r")$"


def classify_media(manifest: DataFrame) -> DataFrame:
    """Add ``kind``: url, video, audio, json, subtitle, text, image or other."""
    suffix = F.lower(F.regexp_extract("path", SUFFIX_PATTERN, 1))
    kind: Column = F.when(F.col("path").rlike(URL_PATTERN), "url")
    for name, suffixes in KINDS:
        kind = kind.when(suffix.isin(*suffixes), name)
    return manifest.withColumn("kind", kind.otherwise("other"))


def media_root(manifest: DataFrame) -> DataFrame:
    """Add ``root``: the path without its suffix and without one stage suffix."""
    bare = F.regexp_replace("path", r"([^/])\.[^./]+$", "$1")
    return manifest.withColumn("root", F.regexp_replace(bare, STAGE_PATTERN, ""))


def codec_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.CODEC_EXTENSIONS), "codec string, ext string")


def audio_extension(manifest: DataFrame) -> DataFrame:
    """Add ``ext``: the file extension of the codec, or its name."""
    known = F.broadcast(codec_table(manifest.sparkSession))  # the ten rows above
    return manifest.join(known, "codec", "left").withColumn("ext", F.coalesce("ext", "codec"))


def load_contexts(spark: SparkSession, path: str, media: DataFrame) -> DataFrame:
    """(media_id, context): the stripped text of each media's file; empty without one."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("media_id"), F.col("value").alias("context"))
    return join_contexts(media, files)


def join_contexts(media: DataFrame, files: DataFrame) -> DataFrame:
    x = media.select("media_id").join(files.withColumn("media_id", F.col("media_id").cast(media.schema["media_id"].dataType)), "media_id", "left")
    return x.select("media_id", strip(F.coalesce("context", F.lit(""))).alias("context"))
