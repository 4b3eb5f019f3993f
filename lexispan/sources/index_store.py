"""The published index: tables under ``v=<build>``, and a pointer that readers resolve once.

Large tables are kept in parts: a full build is one part, an update adds one that holds the videos it replaces and a list of them. A row of a
part counts unless a later part replaces its video. Small tables (counts) are whole in each build. The pointer names the build and its parts and is
moved last, so a job that dies leaves the index as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
#: Tables in parts, all with a video_key; the list of videos that a part replaces; list sizes up to which a list is broadcast.
PARTED = ("segments", "stream_tokens", "token_lists", "ngrams_by_video", "span_counts")
REPLACED = "replaced"
BROADCAST_VIDEOS = 100_000


class IndexUnavailable(RuntimeError):
    """No index, or one of another schema version."""


def _written(tables: dict[str, DataFrame], base: str, by_token: bool) -> None:
    """Token streams are partitioned by language and sorted by token, so that a phrase's first words prune row groups. Without ``by_token`` they stay in the
    order of the texts: nothing is shuffled or sorted, and what a segment's tokens have in common takes next to no space."""
    for name, df in tables.items():
        if name == "stream_tokens" and not by_token:
            df.write.option("compression", "zstd").partitionBy("source_language").mode("errorifexists").parquet(f"{base}/{name}")
        elif name == "stream_tokens":
            ordered = df.repartition("source_language", F.pmod(F.xxhash64("tok"), F.lit(64))).sortWithinPartitions("tok", "kind")
            ordered.write.partitionBy("source_language").mode("errorifexists").parquet(f"{base}/{name}")
        elif name == "token_lists":
            df.write.option("compression", "zstd").mode("errorifexists").parquet(f"{base}/{name}")
        else:
            df.write.mode("errorifexists").parquet(f"{base}/{name}")


def publish(tables: dict[str, DataFrame], root: str, build: str, parts: list[str] | None = None, by_token: bool = True) -> str:
    """Writes all tables of a build, then moves the pointer; a failure before that leaves the old index in use. ``parts``: the earlier
    builds whose parts stay in use."""
    base = f"{root.rstrip('/')}/v={build}"
    _written(tables, base, by_token)
    spark = next(iter(tables.values())).sparkSession
    pointer = spark.createDataFrame([(build, SCHEMA_VERSION, [*(parts or []), build])], "build string, schema_version int, parts array<string>").withColumn("published_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/pointer")
    return base


def _pointed(spark: SparkSession, root: str) -> dict:
    schema = "build string, schema_version int, parts array<string>, published_at timestamp"
    try:
        row = spark.read.schema(schema).json(f"{root.rstrip('/')}/pointer").orderBy(F.desc("published_at"), F.desc("build")).first()
    except Exception as error:
        raise IndexUnavailable(f"no index at {root}") from error
    if row is None:
        raise IndexUnavailable(f"no index at {root}")
    if row["schema_version"] != SCHEMA_VERSION:
        raise IndexUnavailable("the index has another schema version; build it again")
    return row.asDict()


def current(spark: SparkSession, root: str) -> str:
    """Folder of the build that was published last."""
    return f"{root.rstrip('/')}/v={_pointed(spark, root)['build']}"


def live_parts(spark: SparkSession, root: str) -> list[str]:
    """Builds whose parts are in use, oldest first."""
    return _pointed(spark, root)["parts"]


def opened(spark: SparkSession, root: str, name: str) -> DataFrame:
    root, pointed = root.rstrip("/"), _pointed(spark, root)
    if name not in PARTED or len(pointed["parts"]) == 1:
        return spark.read.parquet(f"{root}/v={pointed['build']}/{name}")
    out, gone = [], None
    for part in reversed(pointed["parts"]):
        rows = spark.read.parquet(f"{root}/v={part}/{name}")
        out.append(rows if gone is None else rows.join(gone, "video_key", "left_anti"))
        if part != pointed["parts"][0]:
            own = spark.read.parquet(f"{root}/v={part}/{REPLACED}")
            every = own if gone is None else gone.union(own).distinct()
            gone = F.broadcast(every) if every.count() <= BROADCAST_VIDEOS else every
    return reduce(lambda x, y: x.unionByName(y), out)


def write_stage(rows: DataFrame, root: str, stage: str) -> None:
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{stage}")


def latest_stage(spark: SparkSession, root: str, stages: list[str]) -> DataFrame:
    """Rows of the last stage that was written."""
    for stage in reversed(stages):
        try:
            return spark.read.parquet(f"{root.rstrip('/')}/{stage}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"none of {stages} at {root}")
