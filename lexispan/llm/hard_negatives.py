"""Hard negatives by inner product, searched with length buckets and coordinate pruning (after LEMP).

Rows are put into shelves: buckets of like length (the shortest has 0.9 of the longest), cut into pieces of about ``SHELF`` rows. A shelf holds its rows'
codes and, for each coordinate, the order of the rows by that coordinate of the unit vector. For an anchor and a least score, a shelf is left out
if even its longest row can't reach it. Else a row must lie within an angle of the anchor, so each focus coordinate (the anchor's largest ones) of
it must lie in a range; the rows of these ranges are found in the sorted lists and counted, and those in all ranges are verified exactly. Where
the ranges hold most of the shelf, all its rows are verified at once.

Two searches use this. An anchor's positives are sought on shelves of its label: a pilot against the first of them gives a least score for the rest. Negatives
are sought on shelves of all labels; half the least positive score bounds them. Anchors are packed into blocks of ``BLOCK``; a block meets a shelf in one task,
and what leaves the task are a few rows for each anchor. Anchors go to the shelves' groups through a shuffle, nothing is broadcast without a measured size.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Rows that repeat whole (id, label and codes) count
once; rows that share an id only are different rows. Codes are ``floor(256 * x)`` held to 64 bits; scores are exact integers (beyond 2 ** 53 by Python's
integers) held to 64 bits. Vectors of unequal length have zeros behind. An empty table gives no rows, as does a table without anchors. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.llm.common import dropped, packed, settings, stored

SHELF, BLOCK = 2048, 256
#: Shelves and blocks that meet in one group.
SEAT, LANE = 8, 16
#: Shortest to longest within a bucket.
RATIO = 0.9
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 5
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Least and largest negative score, in percent of the positive's.
BAND = (50, 95)

_LIMIT = 2**63 - 1
_FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
_SHELF = "kind long, bucket int, piece long, longest double, dim int, rids array<long>, ids array<long>, labels array<long>, codes array<long>, sorted array<short>"


def coded(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, label (as mining takes it), codes of the rows that take part. ``rid`` is to be written before it is used."""
    finite = F.forall("embedding", lambda x: F.isnotnull(x) & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as long) + 1) % 10 else cast(label as long) end")
    codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    once = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), codes.alias("codes")).distinct()
    length = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / (-2 * math.log(RATIO)))).otherwise(-1).cast("int")
    return once.select(F.monotonically_increasing_id().alias("rid"), "*", length.alias("length")).withColumn("bucket", bucket)


def _matrix(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Lists of codes as rows, with zeros behind shorter ones."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.value_lengths().to_numpy(), column.flatten().to_numpy()


def _unit(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for zero) and lengths."""
    x = codes.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length


def _shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs as shelves: codes one after the other, and the sorted list of each coordinate."""
    for batch in batches:
        for k in range(len(batch)):
            members = batch["members"].slice(k, 1).flatten()
            codes = _matrix(*_lists(members.field("codes")))
            unit, length = _unit(codes)
            lists = [members.field(c).to_numpy() for c in ("rid", "vec_id", "label")]
            lists += [codes.ravel(), np.argsort(unit, axis=0, kind="stable").T.astype(np.int16).ravel()]
            yield pa.RecordBatch.from_arrays(
                [batch[c].slice(k, 1) for c in ("kind", "bucket", "piece")]
                + [pa.array([length.max(initial=0)]), pa.array([codes.shape[1]], pa.int32()), *(pa.array([x]) for x in lists)],
                names=["kind", "bucket", "piece", "longest", "dim", "rids", "ids", "labels", "codes", "sorted"],
            )


def shelves(rows: DataFrame, label: str) -> DataFrame:
    """The index of ``rows`` (kind, bucket, rid, vec_id, label, codes), written."""
    with settings(rows.sparkSession, _FEW):
        packs = packed(rows, ["kind", "bucket"], SHELF, ["rid", "vec_id", "label", "codes"], "rid")
        return stored(packs.mapInArrow(_shelved, _SHELF), label)


def _meetings(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Blocks beside the shelves of their kind that they may need: each group of SEAT shelves and LANE blocks of a kind is a join key of its own."""
    seats = index.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / SEAT).cast("int").alias("seats"))
    lanes = blocks.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / LANE).cast("int").alias("lanes"))
    grid = stored(seats.join(lanes, "kind"), "grid")
    key = F.struct("kind", "seat", "lane").alias("key")
    x = blocks.withColumnRenamed("piece", "block").join(grid, "kind").withColumn("lane", F.pmod(F.hash("block"), "lanes")).withColumn("seat", F.explode(F.expr("sequence(0, seats - 1)")))
    y = index.join(grid, "kind").withColumn("seat", F.pmod(F.hash("bucket", "piece"), "seats")).withColumn("lane", F.explode(F.expr("sequence(0, lanes - 1)")))
    left = x.select(key, "members", "reach")
    right = y.select(key, *(c for c in index.columns if c not in ("kind", "bucket", "piece")))
    # reach: the least of least score by length over a block's anchors; no row of a shelf is longer than its longest
    return left.join(right, "key").where(F.col("longest") >= F.col("reach")).drop("key")


def feasible(unit: np.ndarray, length: np.ndarray, least: np.ndarray, longest: float, rows: np.ndarray, order: np.ndarray) -> list[np.ndarray | None]:
    """For each anchor (unit vector, length, least score) the rows of a shelf that may reach the score; None for all of them."""
    n, dim = rows.shape
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(least > 0, least / (length * longest), -1.0) * (1 - 1e-12)
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    angle = np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
    most = np.arccos(np.clip(cosine, -1, 1))[:, None]
    low = np.cos(np.minimum(angle + most, np.pi)) - 1e-9
    high = np.cos(np.maximum(angle - most, 0)) + 1e-9
    start, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
    for f in np.unique(focus):
        column, at = rows[order[f], f], focus == f
        start[at], end[at] = np.searchsorted(column, low[at], "left"), np.searchsorted(column, high[at], "right")
    out: list[np.ndarray | None] = []
    for k in range(len(unit)):
        if cosine[k] > 1:
            out.append(np.empty(0, np.int64))
        elif (end[k] - start[k]).min(initial=n) * 2 > n:
            out.append(None)
        else:
            met = np.zeros(n, np.int16)
            for f, a, b in zip(focus[k], start[k], end[k], strict=True):
                met[order[f, a:b]] += 1
            out.append(np.flatnonzero(met == focus.shape[1]))
    return out


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, by floating point where it is exact."""
    dim = min(anchors.shape[1], rows.shape[1])
    x, y = anchors[:, :dim], rows[:, :dim]
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * max(dim, 1)
    if most < 2**52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return np.clip(x.astype(object) @ y.astype(object).T, -_LIMIT, _LIMIT).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``among`` that come first by score and then id."""
    if len(among) > 4 * k:
        least = np.partition(scores[among], len(among) - k)[len(among) - k]
        among = among[scores[among] >= least]
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def _searched(choose):
    """Runs ``choose`` (anchor, scores, ids, labels, rids, candidates) -> rows on each anchor of each meeting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                members = batch["members"].slice(k, 1).flatten()
                anchors = _matrix(*_lists(members.field("codes")))
                unit, length = _unit(anchors)
                least = members.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
                rids, ids, labels, codes, order = (batch[c].slice(k, 1).flatten().to_numpy() for c in ("rids", "ids", "labels", "codes", "sorted"))
                rows = codes.reshape(len(ids), -1)
                dim = max(rows.shape[1], anchors.shape[1])
                wide = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1])))  # noqa: B023, E731
                units, order = wide(_unit(rows)[0]), np.vstack([order.reshape(-1, len(ids)), np.tile(np.arange(len(ids)), (dim - rows.shape[1], 1))])
                places = feasible(wide(unit), length, least, batch["longest"][k].as_py(), units, order)
                whole = np.array([i for i, p in enumerate(places) if p is None], np.int64)
                known = dict(zip(whole.tolist(), _products(anchors[whole], rows), strict=True)) if len(whole) else {}
                out = []
                for i, anchor in enumerate(members.to_pylist()):
                    among = np.arange(len(ids)) if places[i] is None else places[i]
                    scores = known[i] if places[i] is None else _products(anchors[i : i + 1], rows[among])[0]
                    out += [(anchor["rid"], *row) for row in choose(anchor, scores, ids[among], labels[among], rids[among])]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "slot", "id", "score", "other"])

    return run


def _positive(anchor: dict, scores, ids, labels, rids) -> list[tuple]:
    among = np.flatnonzero((labels == anchor["label"]) & (rids != anchor["rid"]))
    return [(0, ids[j].item(), scores[j].item(), rids[j].item()) for j in _first(scores, ids, among, POSITIVES)]


def _negative(anchor: dict, scores, ids, labels, rids) -> list[tuple]:
    out, low, high = [], *BAND
    for slot, positive in enumerate(anchor["positives"]):
        least, most = -(-low * positive // 100), high * positive // 100
        among = np.flatnonzero((labels != anchor["label"]) & (scores >= least) & (scores <= most))
        out += [(slot, ids[j].item(), scores[j].item(), rids[j].item()) for j in _first(scores, ids, among, NEGATIVES)]
    return out


def _search(anchors: DataFrame, index: DataFrame, choose, label: str) -> DataFrame:
    """rid, slot, id, score, other: what ``choose`` finds for the anchors (kind, rid, vec_id, label, codes, length, least, ...) on each shelf."""
    members = [c for c in anchors.columns if c != "kind"]
    with settings(anchors.sparkSession, _FEW):
        blocks = packed(anchors, ["kind"], BLOCK, members, "rid")
        need = F.transform("members", lambda m: F.when((m["least"] > 0) & (m["length"] > 0), m["least"] / F.sqrt(m["length"]) * (1 - 1e-12)).otherwise(0.0))
        blocks = stored(blocks.withColumn("reach", F.array_min(need)), f"{label}-blocks")
        found = stored(_meetings(blocks, index).mapInArrow(_searched(choose), "rid long, slot long, id long, score long, other long"), f"{label}-found")
        dropped(blocks)
        return found


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def positives(rows: DataFrame, label: str) -> DataFrame:
    """rid, rank, id, score: the first rows of its label of each anchor. ``rows``: what ``coded`` gives, written."""
    of_label = rows.withColumn("kind", F.col("label"))
    index = shelves(of_label, f"{label}-labelled")
    anchors = of_label.where(F.col("vec_id") % EVERY == 0).select("kind", "rid", "vec_id", "label", "codes", "length", F.lit(0.0).alias("least"))
    first = index.groupBy("kind").agg(F.max(F.struct("bucket", "piece")).alias("f")).select("kind", "f.bucket", "f.piece")
    pilot = _search(anchors, index.join(first, ["kind", "bucket", "piece"], "left_semi"), _positive, f"{label}-pilot")
    bound = _ranked(pilot, ["rid"], POSITIVES).where(F.col("rank") == POSITIVES).select("rid", F.col("score").cast("double").alias("bound"))
    rest = anchors.join(bound, "rid", "left").withColumn("least", F.coalesce("bound", F.lit(0.0))).select(anchors.columns)
    more = _search(rest, index.join(first, ["kind", "bucket", "piece"], "left_anti"), _positive, f"{label}-rest")
    found = stored(_ranked(pilot.unionByName(more), ["rid"], POSITIVES), f"{label}-positives")
    dropped(index, pilot, more)
    return found.select("rid", "rank", "id", "score")


def hard_negatives(vectors: DataFrame, label: str = "negatives") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors``: vec_id, label, embedding."""
    rows = stored(coded(vectors), f"{label}-rows")
    known = positives(rows, label)
    best = known.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))  # POSITIVES at most
    whole = rows.withColumn("kind", F.lit(0).cast("long"))
    index = shelves(whole, f"{label}-mixed")
    scores = F.transform("best", lambda b: b["score"])
    least = F.array_min(F.transform(scores, lambda s: F.greatest(s.cast("double") * BAND[0] / 100, F.lit(0.0))))
    anchors = whole.where(F.col("vec_id") % EVERY == 0).join(best, "rid").select("kind", "rid", "vec_id", "label", "codes", "length", least.alias("least"), scores.alias("positives"))
    found = _ranked(_search(anchors, index, _negative, f"{label}-mined"), ["rid", "slot"], NEGATIVES)
    named = rows.select("rid", F.col("vec_id").alias("anchor_id"))
    of = known.select("rid", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(of, ["rid", "slot"])
        .join(named, "rid")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
