"""Helpers shared by the training-data operators: reading, stored intermediates, results by text, sized joins.

Row identity. Operators whose result depends on a text only work on distinct texts, known by
128 bits of hash (``t1``, ``t2``), and join the result back to the rows: repeated or null ids
never mix different texts, and copies cost a row, not their work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in row keys; its negative is a long, too.
NULL_ID = -(2**63) + 1
#: Largest table that is broadcast, by its packed size (rows in memory take about three times that); beyond it the join
#: shuffles both sides.
BROADCAST_BYTES = 4 << 20
#: A text that more than one in so many rows have is joined by broadcast; there are fewer such texts than this.
HOT_SHARE = 1_000

KEY = ["t1", "t2"]

#: Rows of texts that a Python worker holds at once: with it, texts of a few hundred thousand characters fit, and workers stay small.
FEW_TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}

_paths: dict[int, tuple[DataFrame, str, str | None]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _paths[id(read)] = (read, path, None)
    return read


def bucketed(df: DataFrame, keys: list[str], label: str, order: tuple[str, ...] = ()) -> DataFrame:
    """As ``stored``, in as many buckets of ``keys`` as shuffles have partitions, sorted by ``order`` if given: joins on these keys
    move the other side only. The table is named in the session's catalog until ``dropped``; a job that dies leaves name and files there."""
    spark = df.sparkSession
    path, name = scratch(spark, label), f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write = df.write.bucketBy(n, *keys)
    write = write.sortBy(*order) if order else write
    write.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    read = spark.table(name)
    _paths[id(read)] = (read, path, name)
    return read


def moved(table: DataFrame, view: DataFrame) -> DataFrame:
    """``view``, which stands for the stored ``table`` from now on: dropping it deletes the table."""
    _paths[id(view)] = (view, *_paths.pop(id(table))[1:])
    return view


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        _, path, name = _paths.pop(id(table), (None, None, None))
        if path:
            spark = table.sparkSession
            if name:
                spark.sql(f"drop table {name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with ``values``, until what is written inside is written."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_of(docs: DataFrame) -> Column:
    """The text of ``docs`` as a string, empty if it is null."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def distinct_texts(docs: DataFrame, label: str) -> DataFrame:
    """t1, t2, copies, text of every different text, in buckets of the key: texts are shuffled once."""
    rows = docs.select(text_of(docs).alias("text"))
    once = rows.select(*text_key(F.col("text")), "text").groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return bucketed(once, KEY, label)


def by_text(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``rows`` (with t1, t2) joined to ``results`` (t1, t2, copies, ...), null where there is none.

    Texts of which there are very many copies would put all their rows into one task of a shuffle. Of those that more
    than one row in ``HOT_SHARE`` has there are fewer than ``HOT_SHARE``, whatever the input: their results are
    broadcast, all others are joined by a shuffle in which no text has more rows than that share."""
    total = results.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = F.col("copies") * HOT_SHARE > max(total, HOT_SHARE)
    many, few = results.where(hot).drop("copies"), results.where(~hot).drop("copies")
    known = F.broadcast(many.select(*KEY))
    return rows.join(F.broadcast(many), KEY).unionByName(rows.join(known, KEY, "left_anti").join(few, KEY, "left"))


def sized(df: DataFrame, size_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast only if its measured size is within ``limit``."""
    return F.broadcast(df) if size_bytes <= limit else df


def packed(rows: DataFrame, keys: list[str], size: int, members: list[str], by: str) -> DataFrame:
    """Rows in packs of about ``size`` by ``keys``: keys, piece, members. A key of any number of rows is dealt to as many packs as it needs,
    by the hash of ``by``."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > size)
    counts = stored(counts.select(*keys, F.ceil(F.col("rows") / size).alias("pieces")), "packs")  # less than a row for ``size`` rows
    dealt = rows.join(sized(counts, 40 * counts.count()), keys, "left")
    piece = F.pmod(F.xxhash64(by), F.coalesce("pieces", F.lit(1)))
    return dealt.withColumn("piece", piece).groupBy(*keys, "piece").agg(F.collect_list(F.struct(*members)).alias("members"))
