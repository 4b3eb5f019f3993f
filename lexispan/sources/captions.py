"""Caption caches: payloads and metadata by ``<language>/<video>/<track>/`` folders, checked against path and checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan import schemas


def _part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    path = F.col("path")
    return read.select(
        F.url_decode("path").alias("path"), "content", "length", _part(path, 4).alias("p_language"), _part(path, 3).alias("p_video"), _part(path, 2).alias("p_track")
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """One row for each track: metadata, parsed events, and why it is unusable, if it is (``problem``)."""
    text = lambda c: F.decode(c, "UTF-8")
    meta = _files(spark, root, "metadata.json").select(
        "p_language", "p_video", "p_track", F.from_json(text("content"), schemas.METADATA, {"mode": "PERMISSIVE"}).alias("m")
    )
    captions = _files(spark, root, "captions.json3").select(
        "p_language", "p_video", "p_track", F.sha2("content", 256).alias("sha"), F.from_json(text("content"), schemas.CAPTIONS).alias("c")
    )
    both = meta.join(captions, ["p_language", "p_video", "p_track"], "left")
    problem = (
        F.when(F.col("m.track_id").isNull(), "unreadable metadata")
        .when((F.col("m.source_language") != F.col("p_language")) | (F.col("m.video_key") != F.col("p_video")) | (F.col("m.track_id") != F.col("p_track")), "metadata and path differ")
        .when(F.col("sha").isNull(), "no captions")
        .when(F.col("sha") != F.col("m.content_sha256"), "checksum differs")
        .when(F.coalesce(F.size("c.events"), F.lit(0)) <= 0, "no events")
    )
    return both.select("m.*", F.col("c.events").alias("events"), problem.alias("problem"))


def checked(tracks: DataFrame) -> DataFrame:
    """``tracks``, failing with the reason at the first row that has a problem."""
    ok = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(": ", "track_id", "problem")).cast("boolean"))
    return tracks.where(ok).drop("problem")


def canonical(tracks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Only the track that a video's manifest names; all tracks of videos without a manifest."""
    named = manifests.select(F.col("video_key").alias("_v"), F.col("canonical_source_track_id").alias("_t")).where("_t is not null")
    joined = tracks.join(named, tracks.video_key == F.col("_v"), "left")
    return joined.where(F.col("_t").isNull() | (F.col("_t") == F.col("track_id"))).drop("_v", "_t")


def without_disabled(tracks: DataFrame, channels: DataFrame) -> DataFrame:
    """Tracks but those of channels whose catalogue entry says ``enabled: false``; unlisted channels stay."""
    off = channels.where("enabled = false").select(F.col("language").alias("source_language"), F.col("id").alias("channel_config_id"))
    return tracks.join(off, ["source_language", "channel_config_id"], "left_anti")


def channels(spark: SparkSession, path: str) -> DataFrame:
    """Channels of catalogue files: language, section, id, name, url, enabled, varieties, speech_style."""
    read = spark.read.schema(schemas.CATALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    listed = read.select("language", F.explode("sections").alias("s")).select("language", F.col("s.id").alias("section"), F.explode("s.channels").alias("c"))
    return listed.select("language", "section", "c.*").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def catalogue_problems(channel_rows: DataFrame) -> DataFrame:
    """Channels that are listed twice in a language, or whose id isn't in kebab case."""
    twice = channel_rows.groupBy("language", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("language", "id", F.lit("listed twice").alias("problem"))
    odd = channel_rows.where(~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")).select("language", "id", F.lit("not in kebab case").alias("problem"))
    return twice.unionByName(odd)


def storage(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes by language and video, with subtotals."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    placed = listed.select(_part(F.col("path"), 4).alias("language"), _part(F.col("path"), 3).alias("video"), "length")
    return placed.rollup("language", "video").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.grouping_id().alias("level"))
