"""Intervals by resampling whole clusters (videos): words of one cluster fail together, so clusters are drawn, not words.

A draw gives every cluster of a cell a weight, how often it was drawn; statistics are weighted ones, so no row is repeated. Draws are by
SHA-256 of seed, round and place, so any engine draws alike. Cells of fewer than two clusters have no interval.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexispan.sources.scratch import written

#: Ranges of values of a cell in which a quantile is looked for first.
RANGES = 64
#: Clusters whose weights are kept together.
SPAN = 4096


def numbered(rows: DataFrame, cells: list[str], cluster: str) -> DataFrame:
    """cells, cluster, k (from 0, by the SHA-256 of the cluster) and m (clusters of the cell). Clusters are numbered within ranges
    of the digest and ranges added up, so no task sorts a whole cell."""
    digest = F.sha2(F.col(cluster).cast("string"), 256)
    own = rows.where(F.col(cluster).isNotNull()).select(*cells, cluster).distinct().withColumn("_digest", digest).withColumn("_range", F.left("_digest", F.lit(3)))
    counts = own.groupBy(*cells, "_range").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*cells)
    ahead = counts.select(
        *cells, "_range", F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_n").over(over).alias("m")
    )
    place = F.row_number().over(Window.partitionBy(*cells, "_range").orderBy("_digest")) - 1
    return own.withColumn("_place", place).join(ahead, [*cells, "_range"]).select(*cells, cluster, (F.col("_ahead") + F.col("_place")).alias("k"), "m")


def _digits(seed: str, a_round: int, size: int) -> np.ndarray:
    """The first 32 bits of the SHA-256 of seed, round and place, for places from 1."""
    head = hashlib.sha256(f"{seed}:{a_round}:".encode())
    out = bytearray()
    for i in range(1, size + 1):
        one = head.copy()
        one.update(b"%d" % i)
        out += one.digest()[:4]
    return np.frombuffer(bytes(out), ">u4").astype(np.int64)


def _drawn(seed: str):
    """Weights of each cell's clusters in a round, packed by part; a round's digests are the same for all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digits = -1, np.empty(0, np.int64)
        for batch in batches:
            rows, parts, packed = [], [], []
            for row, (m, a_round) in enumerate(zip(batch["m"].to_pylist(), batch["round"].to_pylist(), strict=True)):
                if a_round != of or len(digits) < m:
                    of, digits = a_round, _digits(seed, a_round, m)
                w = np.bincount(digits[:m] % m, minlength=m).astype(np.uint16)
                for part, at in enumerate(range(0, m, SPAN)):
                    rows.append(row)
                    parts.append(part)
                    packed.append(zlib.compress(w[at : at + SPAN].tobytes(), 1))
            own = [batch[c].take(pa.array(rows, pa.int64())) for c in batch.schema.names if c != "m"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(parts, pa.int64()), pa.array(packed, pa.binary())], names=[c for c in batch.schema.names if c != "m"] + ["part", "w"])

    return run


def weights(known: DataFrame, cells: list[str], rounds: int, seed: str) -> DataFrame:
    """cells, round, part, w: how often each cluster of a part (``SPAN`` neighbours by k) is drawn in each round, packed; as many draws as the cell has
    clusters. ``known``: see ``numbered``. Cells of one cluster aren't there."""
    sizes = known.select(*cells, "m").distinct().where("m > 1")
    each = F.broadcast(known.sparkSession.range(rounds).select(F.col("id").alias("round")))
    draws = sizes.crossJoin(each).select(*cells, "m", "round").repartition("round").sortWithinPartitions("round", F.desc("m"))
    kinds = [sizes.schema[c] for c in cells]
    return draws.mapInArrow(_drawn(seed), T.StructType([*kinds, T.StructField("round", T.LongType()), T.StructField("part", T.LongType()), T.StructField("w", T.BinaryType())]))


def _matrix(drawn: pa.Table, rounds: int) -> np.ndarray:
    """Weights of a part's clusters, a column for each round."""
    columns = {r: np.frombuffer(zlib.decompress(w), np.uint16) for r, w in zip(drawn["round"].to_pylist(), drawn["w"].to_pylist(), strict=True)}
    return np.stack([columns[r] for r in range(rounds)], 1)


def _cogrouped(left: DataFrame, drawn: DataFrame, cells: list[str], run, fields: list[T.StructField]) -> DataFrame:
    """``run(rows, weights)`` on the rows and the weights of each part; its columns follow the cell's."""
    kinds = [left.schema[c] for c in cells]

    def each(rows: pa.Table, weighed: pa.Table) -> pa.Table:
        if not len(rows) or not len(weighed):
            columns, n = [pa.array([], type=to_arrow_type(f.dataType)) for f in fields], 0
        else:
            columns = run(rows, weighed)
            n = len(columns[0])
        own = [rows[c].slice(0, 1).take(pa.array([0] * n, pa.int64())) if n else pa.array([], type=rows.schema.field(c).type) for c in cells]
        return pa.Table.from_arrays([*own, *columns], names=[*cells, *(f.name for f in fields)])

    keys = [*cells, "part"]
    return left.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInArrow(each, T.StructType([*kinds, *fields]))


def weighted_estimates(rows: DataFrame, cells: list[str], cluster: str, value: str, known: DataFrame, drawn: DataFrame, rounds: int, fraction: float, within: Column) -> DataFrame:
    """cells, round, quantile, share: the quantile of each round's values, between neighbours by distance, and the share of them for which ``within`` holds, as
    if each value stood there as often as its cluster was drawn. A part's clusters meet their weights of all rounds at once. Ranges of values are weighed
    first, and only the values of those in which the quantile lies are put in order."""
    edges = rows.groupBy(*cells).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("edges"))
    placed = rows.join(known, [*cells, cluster]).select(*cells, value, "k", within.alias("_hit"))
    counted = placed.groupBy(*cells, "k", value, "_hit").agg(F.count(F.lit(1)).alias("n"))
    binned = counted.join(F.broadcast(edges), cells).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    binned = written(binned.withColumn("part", F.floor(F.col("k") / SPAN).cast("long")), "resampled-values")

    def masses(table: pa.Table, weighed: pa.Table) -> list[pa.Array]:
        w = _matrix(weighed, rounds).astype(np.float64)
        k, n = table["k"].to_numpy() % SPAN, np.zeros((RANGES + 1, len(w)))
        np.add.at(n, (table["bin"].to_numpy(), k), table["n"].to_numpy())
        np.add.at(n, (np.full(len(k), RANGES), k), table["hits"].to_numpy())
        sums = (n @ w).astype(np.int64)  # whole numbers, exact in doubles
        kept = np.flatnonzero(sums.any(axis=1))
        return [pa.array(kept.astype(np.int32)), pa.array(list(sums[kept]), pa.list_(pa.int64()))]

    # the row of place RANGES counts the hits
    by_bin = binned.groupBy(*cells, "part", "k", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)).alias("hits"))
    found = _cogrouped(by_bin, drawn, cells, masses, [T.StructField("bin", T.IntegerType()), T.StructField("masses", T.ArrayType(T.LongType()))])
    mass = found.select(*cells, "bin", F.posexplode("masses").alias("round", "mass")).groupBy(*cells, "round", "bin").agg(F.sum("mass").alias("mass"))
    mass = written(mass, "resampled-masses")
    over = Window.partitionBy(*cells, "round")
    shares = mass.groupBy(*cells, "round").agg((F.sum(F.when(F.col("bin") == RANGES, F.col("mass")).otherwise(0)) / F.sum(F.when(F.col("bin") < RANGES, F.col("mass")))).alias("share"))
    mass = mass.where(F.col("bin") < RANGES).withColumn("upto", F.sum("mass").over(over.orderBy("bin"))).withColumn("all", F.sum("mass").over(over))
    place = F.lit(fraction) * (F.col("all") - 1)
    mass = mass.withColumn("low", F.floor(place)).withColumn("part", place - F.floor(place)).withColumn("high", F.least(F.col("low") + 1, F.col("all") - 1))
    holds = lambda rank, upto, size: (F.col(rank) < F.col(upto)) & (F.col(rank) >= F.col(upto) - F.col(size))
    wanted = mass.where(holds("low", "upto", "mass") | holds("high", "upto", "mass")).select(*cells, "round", "bin", (F.col("upto") - F.col("mass")).alias("ahead"), "low", "high", "part")
    wanted = written(wanted, "resampled-places")

    def weighed(table: pa.Table, by_round: pa.Table) -> list[pa.Array]:
        w = _matrix(by_round, rounds)[table["k"].to_numpy() % SPAN]
        return [table["bin"].combine_chunks(), table[value].combine_chunks(), table["n"].combine_chunks(), pa.array([zlib.compress(x.tobytes(), 1) for x in w], pa.binary())]

    near = binned.join(F.broadcast(wanted.select(*cells, "bin").distinct()), [*cells, "bin"])
    fields = [T.StructField("bin", T.IntegerType()), binned.schema[value], T.StructField("n", T.LongType()), T.StructField("w", T.BinaryType())]
    vectors = _cogrouped(near, drawn, cells, weighed, fields)

    def ordered(table: pa.Table, asked: pa.Table) -> pa.Table:
        of = asked["round"].to_numpy()
        ahead, ends = asked["ahead"].to_numpy(), {c: asked[c].to_numpy() for c in ("low", "high")}
        upto, values = np.zeros(rounds, np.int64), {c: np.full(len(of), np.nan) for c in ends}
        by_value = np.argsort(table[value].to_numpy())
        xs, ns, ws = table[value].to_numpy()[by_value], table["n"].to_numpy()[by_value], table["w"].combine_chunks().take(pa.array(by_value))
        for x, n, w in zip(xs, ns, ws, strict=True):
            before, upto = upto[of] + ahead, upto + n * np.frombuffer(zlib.decompress(w.as_py()), np.uint16).astype(np.int64)
            after = upto[of] + ahead
            for c, rank in ends.items():
                values[c][(rank < after) & (rank >= before)] = x
        own = [asked[c] for c in cells]
        # a rank that lies in another range of values has none here
        return pa.Table.from_arrays([*own, asked["round"], *(pa.array(values[c], from_pandas=True) for c in ends), asked["part"]], names=[*cells, "round", "x", "y", "part"])

    kinds = [T.StructField("round", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("part", T.DoubleType())]
    keys = [*cells, "bin"]
    met = vectors.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(ordered, T.StructType([*(wanted.schema[c] for c in cells), *kinds]))
    found = met.groupBy(*cells, "round").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.first("part").alias("part"))
    return found.select(*cells, "round", (F.col("x") * (1 - F.col("part")) + F.col("y") * F.col("part")).alias("quantile")).join(shares, [*cells, "round"])


def interval(estimates: DataFrame, cells: list[str], estimate: str, name: str) -> DataFrame:
    """cells, <name>_low and <name>_high: the middle 95 % of the rounds' estimates, which are as few as the rounds."""
    p = F.percentile(estimate, F.array(F.lit(0.025), F.lit(0.975)))
    # between neighbours of few places lie halves of the last place kept, which doubles may just miss
    rounded = lambda x: F.floor(x * 10_000 + (0.5 + 1e-7)) / 10_000
    return estimates.groupBy(*cells).agg(p.alias("p")).select(*cells, rounded(F.col("p")[0]).alias(f"{name}_low"), rounded(F.col("p")[1]).alias(f"{name}_high"))


def error_intervals(errors: DataFrame, cells: list[str], cluster: str, delta: str, tolerance: float = 0.2, rounds: int = 1000, seed: str = "12345") -> DataFrame:
    """cells, clusters, and the intervals of the median size of ``delta`` and of the share of sizes within ``tolerance``; null for cells of fewer than two clusters."""
    sized = errors.where(F.col(delta).isNotNull() & F.col(cluster).isNotNull()).select(*cells, cluster, F.abs(delta).alias("_size"))
    known = written(numbered(sized, cells, cluster), "resampled-clusters")
    drawn = written(weights(known, cells, rounds, seed), "resampled-weights")
    found = written(weighted_estimates(sized, cells, cluster, "_size", known, drawn, rounds, 0.5, F.col("_size") <= tolerance), "resampled-estimates")
    counts = sized.groupBy(*cells).agg(F.count_distinct(cluster).alias("clusters"))
    return counts.join(interval(found, cells, "quantile", "median_abs"), cells, "left").join(interval(found, cells, "share", "within"), cells, "left")
