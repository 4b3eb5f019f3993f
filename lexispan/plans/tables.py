"""The given tables, and how corpus concepts map to them: documents are transcripts, their lines segments, events timed units."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions.text import FOLD_FROM, FOLD_TO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Largest number of keys that is broadcast.
BROADCAST_ROWS = 100_000

#: SQL twins of the folding and token functions.
SQL_FOLD = f"regexp_replace(translate(replace(lower({{0}}), 'ß', 'ss'), '{FOLD_FROM}’', '{FOLD_TO}'''), '\\p{{{{Mn}}}}+', '', 'g')"
SQL_TOKEN = r"'[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({SQL_FOLD.format(text)}, {SQL_TOKEN})"


#: Lines of documents as segments, and the tokens of each with their places.
SQL_SEGMENTS = """seg AS (
  SELECT doc_id, lang, source, generate_subscripts(lines, 1) - 1 AS seg, unnest(lines) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents)),
segs AS (SELECT * FROM seg WHERE trim(text) <> '')"""
SQL_STREAM = f"""{SQL_SEGMENTS},
listed AS (SELECT doc_id, lang, source, seg, text, {sql_tokens('text')} AS toks FROM segs),
tok AS (SELECT doc_id, lang, source, seg, len(toks) AS token_count, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS tok FROM listed)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts that lie in one file are dealt out first, for their analysis is the costly part; larger inputs, which lie in
    many, are read as they lie, without a shuffle."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "documents":
        return read
    return read.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if len(read.inputFiles()) == 1 else read


def by_identity(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows that are alone with their ``keys``, and those that share them or have a null in them (None if there are none). Only the keys are shuffled."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    several = counts.where((F.col("_n") > 1) | blank).select(*keys)
    n = several.count()
    if not n:
        return rows, None
    several = F.broadcast(several) if n <= BROADCAST_ROWS else several
    meet = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    return (rows.alias("x").join(several.alias("y"), meet, how) for how in ("left_anti", "left_semi"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals: user_id, event_id, event_type, start (seconds since 2024), end, value in seconds."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1_704_067_200
    return e.select("event_id", "user_id", "event_type", "value", start.alias("start")).withColumn("end", F.col("start") + F.col("value"))


SQL_TIMED = """timed AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 - 1704067200 AS start,
  epoch_us(ts) / 1000000.0 - 1704067200 + value AS "end" FROM events)"""
