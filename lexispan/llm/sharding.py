"""Sharding by proportional stratified interleaving.

The rows of every source are put in a seeded pseudo-random order and ranked; a row's
fractional rank is (rank - 1 + phase) / rows of its source, where the phase, from 0 to 1, is a seeded
hash of the source, so that the first rows of very many small sources don't all stand at one
place. Ordered by fractional rank, any stretch of the corpus holds every source in proportion, so cutting that order
into equal runs gives shards that match the mixture. Shard sizes differ by one row at most.

No window runs over a whole source or a whole corpus: rows are dealt to fixed ranges of
the ordering key, counted per range (a small aggregate), and numbered inside a range
after the rows of the ranges before it are known.

Nulls: a null source is a source of its own; null ids and null texts are kept (size 16).
Repeated rows are ordered by what distinguishes them and, if nothing does, among
themselves arbitrarily, which leaves the result the same multiset. An empty table gives
no rows. Other columns are ignored. DuckDB has no crc32, so the query is tested against a plain version, not SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.llm.common import documents

SHARDS = 40
SEED = 42
#: Ranges of an ordering key in which rows are numbered.
RANGES = 4096


def numbered(rows: DataFrame, groups: list[str], range_of: Column, order: list[Column], name: str, total: str) -> DataFrame:
    """Adds ``name`` (0-based position within ``groups`` by ``order``) and ``total`` (rows of the group).

    ``range_of`` must be nondecreasing in ``order``; a task holds one range of one group."""
    keyed = rows.withColumn("_range", range_of)
    keys = [*groups, "_range"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    over = Window.partitionBy(*(groups or [F.lit(0)]))
    ahead = counts.select(
        *keys,
        (F.sum("_rows").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_ahead"),
        F.sum("_rows").over(over).alias(total),
    )
    inner = Window.partitionBy(*keys).orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(inner)).alias("l")
    right = ahead.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = ranked.join(right, on)
    return joined.select(
        *[F.col(f"l.{c}") for c in rows.columns],
        (F.coalesce(F.col("r._ahead"), F.lit(0)) + F.col("l._rank") - 1).alias(name),
        F.col(f"r.{total}"),
    )


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source_rows, shard, slot for every row of ``docs``."""
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(data).cast("long") + 16).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("draw"),
    )
    by_draw = [F.col(c) for c in ("draw", "doc_id", "text_crc32", "size")]
    of_draw = F.shiftrightunsigned("draw", 64 - 12).bitwiseXOR(F.lit(RANGES // 2))
    ranked = numbered(rows, ["source"], of_draw, by_draw, "rank", "source_rows")
    phase = F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), F.col("source")), F.lit(1 << 20)) / (1 << 20)
    placed = ranked.withColumn("fraction", (F.col("rank") + phase) / F.col("source_rows"))
    by_fraction = [F.col(c) for c in ("fraction", "source", "draw", "doc_id", "text_crc32", "size")]
    of_fraction = F.floor(F.col("fraction") * RANGES)
    ordered = numbered(placed, [], of_fraction, by_fraction, "position", "rows")
    return (
        ordered.withColumn("shard", F.expr(f"(position * {shards}) div rows"))
        .withColumn("slot", F.col("position") - F.expr(f"(shard * rows + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "source_rows", F.col("shard").cast("int").alias("shard"), "slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved_shards(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

