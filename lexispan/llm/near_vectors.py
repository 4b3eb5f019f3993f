"""Embedding near-dedup by counted collisions of sorted projections.

Vectors are projected on many random directions. A table is one direction whose values are sorted, cut into pages by the signs of ``k`` others; two vectors
collide in a table if they share its page and the value of one lies in the window centred on the other's. Pairs that collide in ``NEED`` tables or more
are verified. The number of tables is calibrated: a pair at the threshold keeps its signs with a known chance and its distance with another, so a binomial tail
gives the tables that find it with a chance of ``RECALL``; nearer pairs collide more often. Without pages the windows of one direction hold a part of all vectors
that doesn't shrink with their number (3 % for one that holds 9 % of the pairs at 0.9), so that counts would take more work than all pairs; ``k`` grows until pages
hold ``PAGE`` others on average, which makes more tables but keeps the rows of a table few, however the vectors lie.

Exact copies are one node. Groups of near copies are balls: vectors within half the threshold's angle of one centre. By the triangle inequality all of a ball link,
so they are counted, not paired. Collisions are counted between balls; from the angle of the centres and the radii, most candidates link wholly or not at all, and
only where that is open are members compared, in blocks which give counts. So a group of any size costs a few rows a member, and no pair is listed.

A vector that is null, empty, zero or has a null or non-finite component links with nothing; vectors of unequal lengths don't link. The cosine is taken in double precision.
Rows that repeat are vectors of their own, linked as copies; the component is the least id that isn't null; a row without an id isn't kept. An empty table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import KEY, by_text, dropped, packed, settings, stored
from lexispan.llm.components import least_labels

COSINE = 0.9
#: Collisions that make a candidate, and the chance that a pair at the threshold has as many.
NEED, RECALL = 2, 0.999
#: Half a window, in standard deviations of the difference of a pair at the threshold.
WINDOW = 1.96
#: Others on a page, on average; bits of a page at most.
PAGE, MOST_BITS = 4, 30
#: Tables and signs by which centres of balls are found; what they miss is left to the collisions.
CENTRE_TABLES, CENTRE_BITS = 24, 24
CHUNK = 1024
SEED = 20

_SLACK = 1e-7


def directions(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """For each table ``bits`` directions for signs and one for the sorted value."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * (bits + 1)))


def tables_for(bits: int, cosine: float = COSINE) -> int:
    """Least number of tables in which a pair at the threshold collides NEED times with a chance of RECALL."""
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(WINDOW / math.sqrt(2))
    t = NEED
    while sum(math.comb(t, i) * p**i * (1 - p) ** (t - i) for i in range(NEED)) > 1 - RECALL:
        t += 1
    return t


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in ``batch``: the length, which rows have it, and their unit vectors."""
    sizes, values = batch["vector"].value_lengths().to_numpy(), batch["vector"].flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        x = values[starts[at][:, None] + np.arange(dim)]
        yield dim, at, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _pages(tables: int, bits: int, seed: int, names: list[str]):
    """node columns ``names``, page, h: a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits, dtype=np.int64))[None, None]
        for batch in batches:
            for dim, at, unit in _vectors(batch):
                for k in range(0, len(at), 2048):
                    some = at[k : k + 2048]
                    values = (unit[k : k + 2048] @ directions(dim, tables, bits, seed)).reshape(len(some), tables, bits + 1)
                    page = ((values[:, :, :bits] > 0) * weights).sum(axis=2) + (np.arange(tables, dtype=np.int64) << 48)[None] + ((dim & 0xFFFF) << 32)
                    own = [batch[c].take(pa.array(np.repeat(some, tables))) for c in names]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(page.ravel()), pa.array(values[:, :, bits].ravel())], names=[*names, "page", "h"])

    return run


def _paged(nodes: DataFrame, names: list[str], tables: int, bits: int, seed: int) -> DataFrame:
    return nodes.select(*names, "vector").mapInArrow(_pages(tables, bits, seed, names), ", ".join(f"{c} long" for c in names) + ", page long, h double")


def _cosine(x: str, y: str):
    """Of unit vectors."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _with_vector(rows: DataFrame, key: str, vectors: DataFrame, name: str) -> DataFrame:
    """``rows`` with the vector of the node in ``key``; nodes that very many rows name are broadcast, see ``by_text``."""
    uses = rows.groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("copies"))
    known = uses.join(vectors, "node").select(F.col("node").alias(KEY[0]), F.lit(0).alias(KEY[1]), "copies", F.col("vector").alias(name))
    return by_text(rows.withColumn(KEY[0], F.col(key)).withColumn(KEY[1], F.lit(0)), stored(known, "centres")).drop(*KEY)


def balls(nodes: DataFrame, label: str, cosine: float = COSINE) -> DataFrame:
    """node, ball (a node at its centre), angle to the centre. ``nodes``: node, vector (unit)."""
    paged = stored(_paged(nodes, ["node"], CENTRE_TABLES, CENTRE_BITS, SEED).select("page", "node"), f"{label}-centre-pages")
    centres = paged.groupBy("page").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre != last").select("page", "centre")
    offers = stored(paged.join(centres, "page").where("node != centre").select("node", "centre").distinct(), f"{label}-offers")
    both = _with_vector(_with_vector(offers, "centre", nodes, "x"), "node", nodes, "y")
    near = both.withColumn("angle", F.acos(F.least(_cosine("x", "y"), F.lit(1.0)))).where(F.col("angle") <= math.acos(cosine) / 2 - _SLACK)
    chosen = near.groupBy("node").agg(F.min(F.struct("centre", "angle")).alias("c"))
    placed = nodes.select("node").join(chosen, "node", "left").select("node", F.coalesce("c.centre", "node").alias("ball"), F.coalesce("c.angle", F.lit(0.0)).alias("angle"))
    out = stored(placed, f"{label}-balls")
    dropped(paged, offers)
    return out


def page_bits(nodes: DataFrame) -> int:
    """Signs of a page, so that pages hold PAGE others on average: pairs on pages are counted, for vectors may lie close together."""
    n = nodes.count()
    bits = max(2, round(math.log2(max(n, 2))) - 2)
    while bits < MOST_BITS:
        sizes = _paged(nodes, ["node"], 4, bits, SEED + 1).groupBy("page").agg(F.count(F.lit(1)).alias("s"))
        pairs = sizes.agg(F.sum((F.col("s") * (F.col("s") - 1)).cast("double")).alias("p")).first()["p"] or 0.0
        if pairs <= 2 * PAGE * 4 * n:
            break
        bits += 1
    return bits


def _collided(window: float):
    """Pairs (a, b) of rows (page, ball, low, high), sorted by page and low, whose windows meet."""

    def pairs(page: np.ndarray, ball: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        shift = np.concatenate([[0], np.cumsum(page[1:] != page[:-1])]) * 1e4
        end = np.searchsorted(low + shift, high + window + shift, "right")
        counts = end - np.arange(len(page)) - 1
        for part in np.array_split(np.arange(len(page)), max(1, int(counts.sum()) >> 19)):
            first = np.repeat(part, counts[part])
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
            a, b = ball[first], ball[second]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]
        for batch in batches:
            rows = [np.concatenate([k, batch[c].to_numpy()]) for k, c in zip(kept, ("page", "ball", "low", "high"), strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last page may go on
            yield from pairs(*(r[:cut] for r in rows))
            kept = [r[cut:] for r in rows]
        yield from pairs(*kept)

    return run


def candidates(nodes: DataFrame, placed: DataFrame, label: str, cosine: float = COSINE) -> DataFrame:
    """a, b: balls whose members collide in NEED tables or more."""
    sizes = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("s"))
    bits = page_bits(nodes.join(sizes.select(F.col("ball").alias("node")), "node", "left_semi"))
    members = stored(nodes.join(placed.select("node", "ball"), "node").join(sizes, "ball").select("node", "ball", "s", "vector"), f"{label}-members")
    paged = lambda some: _paged(some, ["ball"], tables_for(bits, cosine), bits, SEED + 2)
    single = paged(members.where("s = 1")).select("page", "ball", F.col("h").alias("low"), F.col("h").alias("high"))
    spans = single.unionByName(paged(members.where("s > 1")).groupBy("page", "ball").agg(F.min("h").alias("low"), F.max("h").alias("high")))
    window = WINDOW * math.sqrt(2 - 2 * cosine)
    met = spans.repartition("page").sortWithinPartitions("page", "low").select("page", "ball", "low", "high").mapInArrow(_collided(window), "a long, b long")
    out = stored(met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= NEED).select("a", "b"), f"{label}-candidates")
    dropped(members)
    return out


def _compared(cosine: float):
    """a, b, node, links of the members of two packs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sides = [batch[c].slice(k, 1).flatten() for c in ("x", "y")]
                nodes, copies = ([s.field(f).to_numpy() for s in sides] for f in ("node", "copies"))
                vectors = [np.stack(s.field("vector").to_numpy(zero_copy_only=False)) for s in sides]
                if vectors[0].shape[1] != vectors[1].shape[1]:
                    continue
                hit = vectors[0] @ vectors[1].T >= cosine
                counts = np.concatenate([hit @ copies[1], copies[0] @ hit])
                some = np.flatnonzero(counts)
                same = lambda c: pa.array(np.full(len(some), batch[c][k].as_py(), np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("a"), same("b"), pa.array(np.concatenate(nodes)[some]), pa.array(counts[some])], names=["a", "b", "node", "links"])

    return run


def _settled(found: DataFrame, nodes: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """Candidate balls (a, b) that link wholly (open: false) or may in part (open: true), with the vectors that each holds."""
    theta, single = math.acos(cosine), (F.col("members") == 1) & (F.col("one") == F.col("ball"))
    side = sizes.select("ball", "size", "radius", single.alias("single"))
    named = lambda k: side.select(*(F.col(c).alias(c if c == k else f"{c}_{k}") for c in ("ball", "size", "radius", "single"))).withColumnRenamed(f"ball_{k}", k)
    known = found.join(named("a"), "a").join(named("b"), "b")
    cosines = _with_vector(_with_vector(known, "a", nodes, "x"), "b", nodes, "y").withColumn("cosine", _cosine("x", "y")).drop("x", "y")
    angle, reach = F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))), F.col("radius_a") + F.col("radius_b")
    both = F.col("single_a") & F.col("single_b")
    kind = F.when(both, F.when(F.col("cosine") >= cosine, "all").otherwise("none")).when(angle + reach <= theta - _SLACK, "all").when(angle - reach > theta + _SLACK, "none").otherwise("part")
    return cosines.select("a", "b", "size_a", "size_b", kind.alias("kind")).where("kind != 'none'")


def linked(vectors: DataFrame, label: str = "near-vectors", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id of every row of ``vectors`` (vec_id, embedding)."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: F.isnotnull(x) & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = wide.select("vec_id", F.when(sound, F.col("vector")).alias("vector")).withColumns({"t1": F.xxhash64("vector"), "t2": F.xxhash64(F.lit(7), "vector")})
    rows = stored(rows, f"{label}-rows")
    once = rows.where("vector is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    # scaled first, so that squares of very large and very small numbers are numbers
    scaled = once.withColumn("most", F.array_max(F.transform("vector", F.abs))).withColumn("vector", F.transform("vector", lambda x: x / F.col("most")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = scaled.withColumn("length", length).withColumn("vector", F.transform("vector", lambda x: x / F.col("length"))).drop("most", "length")
    every = stored(unit.withColumn("node", F.monotonically_increasing_id()), f"{label}-nodes")
    nodes = every.select("node", "copies", "vector")

    placed = balls(nodes.select("node", "vector"), label, cosine)
    found = candidates(nodes.select("node", "vector"), placed, label, cosine)
    sized = placed.join(nodes.select("node", "copies"), "node")
    sizes = stored(
        sized.groupBy("ball").agg(F.sum("copies").alias("size"), F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members"), F.min("node").alias("one")), f"{label}-sizes"
    )
    pairs = stored(_settled(found, nodes.select("node", "vector"), sizes, cosine), f"{label}-pairs")
    whole = pairs.where("kind = 'all'")
    part = pairs.where("kind = 'part'").select("a", "b")
    wanted = part.select(F.col("a").alias("ball")).union(part.select("b")).distinct()
    members = nodes.join(placed.select("node", "ball"), "node").join(wanted, "ball")
    with settings(vectors.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}):
        packs = stored(packed(members, ["ball"], CHUNK, ["node", "copies", "vector"], "node"), f"{label}-packs")
        x, y = (packs.select(F.col("ball").alias(k), F.col("members").alias(m)) for k, m in (("a", "x"), ("b", "y")))
        met = part.join(x, "a").join(y, "b").mapInArrow(_compared(cosine), "a long, b long, node long, links long")
        compared = stored(met, f"{label}-compared")

    labels = least_labels(whole.select("a", "b").union(compared.select("a", "b").distinct()), label)
    by_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("more")).union(whole.select("b", "size_a")).groupBy("ball").agg(F.sum("more").alias("more"))
    by_node = compared.groupBy("node").agg(F.sum("links").alias("links"))
    of_ball = sizes.join(by_ball, "ball", "left").join(labels.withColumnRenamed("node", "ball"), "ball", "left")
    of_ball = of_ball.select("ball", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links_of_ball"), F.coalesce("component", "ball").alias("component"))
    settled = every.select("node", *KEY, "copies", "least").join(placed.select("node", "ball"), "node").join(of_ball, "ball").join(by_node, "node", "left")
    settled = stored(settled.select(*KEY, "copies", "least", "component", (F.col("links_of_ball") + F.coalesce("links", F.lit(0))).alias("n_links")), f"{label}-settled")
    ids = settled.groupBy("component").agg(F.min("least").alias("component_id"))
    results = stored(settled.join(ids, "component").select(*KEY, "copies", "n_links", "component_id"), f"{label}-results")
    dropped(every, placed, found, sizes, pairs, packs, compared, settled)
    out = by_text(rows.where("vector is not null").select("vec_id", *KEY), results).select("vec_id", "n_links", "component_id")
    return out.union(rows.where("vector is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
