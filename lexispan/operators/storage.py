"""Stored media against what their manifests declare: each file in exactly one class, and usage by language, channel and video.

Classes that count as usage: raw manifest, raw source (if its manifest says that it is ready), clip and clip manifest. The others are issues, which
totals leave out: unrecognized files (undeclared ones, folders whose name isn't a clip key), clips without a readable manifest, and clips of videos that have no captions (orphans).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The form of a clip key, the folders, and the name of a manifest.
CLIP_KEY = r"^clp_[0-9a-f]{20}$"
RAW, CLIPS, MANIFEST = "raw/audio", "derived/audio/clips", "manifest.json"
USED = ("raw_manifest", "raw_source", "clip", "clip_manifest")
ISSUES = ("unrecognized", "invalid_manifest", "orphan")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``) and bytes of all files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.regexp_replace("path", f"^[a-z]+:/+{base}/", "").alias("path"), "bytes")


def classified(files: DataFrame, videos: DataFrame, raw: DataFrame, clips: DataFrame) -> DataFrame:
    """``files`` (path, bytes) with language, video_key, clip_key and class; null for files outside both folders.

    ``videos``: language, video_key of caption caches. ``raw``: language, video_key, status, source_file of readable manifests. ``clips``: language, video_key,
    clip_key, clip_file of readable manifests."""
    part = F.split("path", "/")
    name, is_raw, is_clip = F.element_at(part, -1), F.col("path").startswith(f"{RAW}/"), F.col("path").startswith(f"{CLIPS}/")
    at = F.when(is_raw, len(RAW.split("/"))).when(is_clip, len(CLIPS.split("/")))
    named = files.select(
        "path", "bytes", name.alias("name"), is_raw.alias("raw"), F.get(part, at).alias("language"), F.get(part, at + 1).alias("video_key"), F.when(is_clip, F.get(part, at + 2)).alias("clip_key"),
        F.size(part).alias("depth"), at.alias("at"),
    )
    known = videos.select("language", "video_key").distinct().withColumn("captioned", F.lit(True))
    own = raw.select("language", "video_key", F.when(F.col("status") == "ready", F.col("source_file")).alias("source_file"))
    declared = clips.select("language", "video_key", "clip_key", "clip_file")
    joined = named.join(known, ["language", "video_key"], "left").join(own, ["language", "video_key"], "left").join(declared, ["language", "video_key", "clip_key"], "left")
    raw_class = F.when((F.col("name") == MANIFEST) & (F.col("depth") == F.col("at") + 3), "raw_manifest").when((F.col("name") == F.col("source_file")) & (F.col("depth") == F.col("at") + 3), "raw_source").otherwise("unrecognized")
    whole = F.col("depth") == F.col("at") + 4
    clip_class = (
        F.when(F.col("captioned").isNull(), "orphan").when(~whole | ~F.col("clip_key").rlike(CLIP_KEY), "unrecognized").when(F.col("clip_file").isNull(), "invalid_manifest")
        .when(F.col("name") == MANIFEST, "clip_manifest").when(F.col("name") == F.col("clip_file"), "clip").otherwise("unrecognized")
    )
    kind = F.when(F.col("raw") & F.col("captioned").isNull(), "orphan").when(F.col("raw"), raw_class).when(F.col("at").isNotNull(), clip_class)
    return joined.select("path", "bytes", "language", "video_key", F.when(F.col("clip_key").rlike(CLIP_KEY), F.col("clip_key")).alias("clip_key"), kind.alias("class"))


def usage(files: DataFrame, videos: DataFrame, raw: DataFrame) -> DataFrame:
    """Videos, their states, files and bytes by language and channel, with subtotals; videos without media are there. ``files``: as ``classified``;
    ``videos``: with channel. A video without a raw manifest is missing."""
    raw_files, clip = F.col("class").isin("raw_manifest", "raw_source"), F.col("class").isin("clip", "clip_manifest")
    sums = files.where(F.col("class").isin(*USED)).groupBy("language", "video_key").agg(
        F.sum(F.when(raw_files, F.col("bytes")).otherwise(0)).alias("raw_bytes"), F.count_if(raw_files).alias("raw_files"),
        F.sum(F.when(clip, F.col("bytes")).otherwise(0)).alias("derived_bytes"), F.count_distinct(F.when(clip, F.col("clip_key"))).alias("derived_clips"),
    )
    each = videos.join(raw.select("language", "video_key", "status"), ["language", "video_key"], "left").join(sums, ["language", "video_key"], "left")
    state = F.coalesce("status", F.lit("missing"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return each.withColumn("state", state).rollup("language", "channel").agg(
        F.count(F.lit(1)).alias("videos"), *(F.count_if(F.col("state") == s).alias(s) for s in ("ready", "failed", "missing")),
        *(zero(c) for c in ("raw_bytes", "raw_files", "derived_bytes", "derived_clips")), F.grouping_id().cast("long").alias("level"),
    )


def issues(files: DataFrame) -> DataFrame:
    """What totals leave out, by class: files, bytes, and the folders that they lie in."""
    return files.where(F.col("class").isin(*ISSUES)).groupBy("language", "class").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("video_key").alias("videos"))
