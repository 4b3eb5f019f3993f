"""Content-addressed caches on tables: upserts, deletes, lookups, latest entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with ``new`` rows in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str]) -> DataFrame:
    """As replaced(), but some columns (a creation time) keep what the old row had."""
    both = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
    pick = lambda c: (
        F.coalesce(f"o.{c}", f"n.{c}") if c in keep_old else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    )
    return both.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def deleted(rows: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows go; a null predicate keeps the row."""
    gone = F.coalesce(predicate, F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("deleted"))


def looked_up(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(cache.withColumn("hit", F.lit(1)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(at, tie)).alias("row")).select(*keys, "row.*")
