"""Streams of timed units: utterances by pauses, first-seen units under a watermark, appends to index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utterances(units: DataFrame, keys: list[str], at: str, pause: str, late: str) -> DataFrame:
    """Sessions of units no ``pause`` apart; each is given out once the watermark has passed its end."""
    marked = units.withWatermark(at, late)
    return marked.groupBy(*keys, F.session_window(at, pause).alias("session")).agg(F.count(F.lit(1)).alias("n_units"), F.min(at).alias("first"), F.max(at).alias("last")).select(
        *keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n_units", "first", "last"
    )


def first_seen(units: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    return units.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(units: DataFrame, keys: list[str], at: str, length: str, step: str, late: str) -> DataFrame:
    counted = units.withWatermark(at, late).groupBy(*keys, F.window(at, length, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def appended(stream: DataFrame, tables: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str):
    """A query that adds each batch's index tables to Parquet folders; a batch that runs again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        for name, df in tables(batch).items():
            df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
