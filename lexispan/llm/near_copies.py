"""Near copies by the Jaccard similarity of five-word shingles: the rule of the pipeline's near-dedup stage.

Two texts link if their sets of five-word shingles have a similarity of 0.8 or more; one
document of each connected component stays. Words are those of ``simhash``. A text of
fewer words is one shingle, a null or blank text has the empty set.

At 0.8 the SimHash fingerprints of two texts differ by about ten of 64 bits, and segments
short enough to differ by one bit at most would have ten bits, which very many unrelated
texts share. So candidates come from MinHash: 30 bands of 5 least values, of which a pair
at the threshold shares one but for 7 in a million (less above it), and which a common
line or passage doesn't bring together. Every candidate is verified on the whole sets.

Equal sets are one node. Within a band, members are first compared with one centre each (a
group of near copies mostly becomes one component by that). What is then still in different
components of a band is compared in two ways, so that no pair is left out that could join two:

* all pairs of a band of ``SMALL`` members or fewer;
* the members of larger bands by how they differ from the band's centre c. D(x) are the shingles that only one of x and c has. Sets x and y are
  similar if and only if D(x) and D(y) differ in at most a ninth of |x| + |y|, so the two have (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2 in common or more, which is
  above zero if one of them isn't similar to c; if both are, they are in its component. Whatever the order of all shingles, they share one from which on so many are
  left of both, and one of them among about the first half of D. The order puts those first by which few members differ from c: what ``COMMON`` members
  or more have is common, and a common shingle is seldom lacked, a rare one seldom had. Of a template's pages and of copies that are edited too much, what
  comes first are their own words: candidates grow with the members, not with their square. Two members meet on the first shingle that they share, and not
  again on the next ones: a row has what comes before it, up to ``BEFORE`` shingles (if the first one lies further on, they meet more often, which changes nothing), and under one of the centres that
  both have. Common shingles are kept in a Bloom filter of fixed size; what it takes
  wrongly for common changes the order, not the result.

Sets and texts are known by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import FEW_TEXTS, dropped, settings, stored, text_key
from lexispan.llm.components import least_labels

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, DEPTH = 30, 5
#: Members of a band of which all pairs are compared, and members of larger bands that make a shingle common.
SMALL, COMMON = 16, 16
#: Shingles of a difference that a row carries of those before its own.
BEFORE = 32
#: Size of the filter of common shingles: 8 MB.
FILTER_BITS = 1 << 26

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Hashes of the runs of ``shingle`` words, in order; one of all words if there are fewer, none without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined, at, starts, ends = b" ".join(words), 0, [], []
    if len(words) <= shingle:
        return [digest(joined, 42)]
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def set_key(grams: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), seed)


def bands(grams: np.ndarray) -> np.ndarray:
    """A long for each band; none of the empty set, which resembles no other."""
    if not len(grams):
        return np.empty(0, np.int64)
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for k in range(0, len(grams), 4096):
        np.minimum(least, (grams[k : k + 4096, None] * _FACTORS).min(axis=0), out=least)
    cells = least.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(c.tobytes(), k) for k, c in enumerate(cells)], dtype=np.uint64).view(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py()) for x in batch["text"]]
        cells = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
        sizes = pa.array([len(s) for s in sets], pa.int32())
        keys = [_signed([set_key(s, seed) for s in sets]) for seed in (7, 8)]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "t1", "t2")), *keys, sizes, cells], names=["doc_id", "t1", "t2", "k1", "k2", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py()).view(np.int64) for x in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(sets, pa.list_(pa.int64()))], names=["key", "grams"])


def _verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """a, b of ``pairs`` whose sets reach the similarity."""
    top, bottom = SIMILAR
    shared = F.size(F.array_intersect("x", "y"))
    found = (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
        .where(shared * (top + bottom) >= (F.size("x") + F.size("y")) * top)
    )
    return stored(found.select("a", "b"), f"{label}-links")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _near_in_size(x: str, y: str) -> Column:
    """Sets of other sizes can't be similar enough."""
    top, bottom = SIMILAR
    return F.least(x, y) * bottom >= F.greatest(x, y) * top


def _common(sets: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter over the shingles of COMMON sets or more: at most FILTER_BITS / 64 rows reach the driver."""
    size = FILTER_BITS.bit_length() - 1
    many = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    at = many.select(F.explode(F.array(*(F.shiftrightunsigned("gram", k * size).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(2)))).alias("bit"))
    slots = at.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out, rows = np.zeros(FILTER_BITS // 64, np.int64), slots.toArrow()
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _is_common(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    size, bits, out = FILTER_BITS.bit_length() - 1, grams.view(np.uint64), np.ones(len(grams), bool)
    for k in range(2):
        at = (bits >> np.uint64(k * size)) & np.uint64(FILTER_BITS - 1)
        out &= (common[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def difference(grams: np.ndarray, centre: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles that only one of two sets has, those first that few differ by: rare ones of its own, common ones that it lacks, common ones
    of its own, and rare ones that it lacks, which are the centre's own."""
    own, lacks = np.setdiff1d(grams, centre, assume_unique=True), np.setdiff1d(centre, grams, assume_unique=True)
    every = np.concatenate([own, lacks])
    rank = np.concatenate([np.where(_is_common(own, common), 2, 0), np.where(_is_common(lacks, common), 1, 3)])
    return every[np.lexsort((every, rank))]


def _differences(common):
    """Rows of each member's difference from its centre: all of members that are far from it, about the first half of others."""
    top, bottom = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference(x.values.to_numpy(), c.values.to_numpy(), common.value) for x, c in zip(batch["grams"], batch["centre_grams"], strict=True)]
            size = np.array([len(d) for d in found], np.int64)
            n, nc = batch["n"].to_numpy().astype(np.int64), np.array([len(c) for c in batch["centre_grams"]], np.int64)
            # similar to the centre: size * (top + bottom) <= (n + nc) * (bottom - top), here 9 and 1
            far = size * (top + bottom) > (n + nc) * (bottom - top)
            half = (size * (top + bottom) + (n - nc) * (bottom - top)) / (2 * (top + bottom))
            rows, place = np.repeat(np.arange(len(batch)), size), np.concatenate([np.empty(0, np.int64), *(np.arange(s) for s in size)])
            first = place < half[rows]
            # what comes before the first that two share is in one set only: a ninth of both sets at most, a quarter of one
            keep = (first | far[rows]) & (place * top <= n[rows] * (bottom - top))
            at = rows[keep]
            length, start = np.minimum(place[keep], BEFORE), (size.cumsum() - size)[at]
            ends = np.concatenate([[0], length.cumsum()])
            every = np.concatenate([np.empty(0, np.int64), *found])
            earlier = every[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
            before = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(earlier, pa.int64()))
            own = [batch[c].take(pa.array(at)) for c in ("pivot", "pivots", "key", "n", "component")]
            columns = [pa.array(every[keep]), before, pa.array(place[keep].astype(np.int32)), pa.array(size[at].astype(np.int32)), pa.array(first[keep]), pa.array(far[at])]
            yield pa.RecordBatch.from_arrays([*columns, *own], names=["gram", "before", "place", "size", "first", "far", "pivot", "pivots", "key", "n", "component"])

    return run


def _by_centre(members: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Pairs (a, b) of different components among the members (key, n, component) of a centre (pivot) that may be similar, by how they differ from it."""
    top, bottom = SIMILAR
    crowd = stored(sets.join(members.select("key").distinct(), "key"), f"{label}-crowd")
    common = crowd.sparkSession.sparkContext.broadcast(_common(crowd))
    members = members.join(members.groupBy("key").agg(F.collect_set("pivot").alias("pivots")), "key")
    both = members.join(sets, "key").join(sets.select(F.col("key").alias("pivot"), F.col("grams").alias("centre_grams")), "pivot")
    schema = "gram long, before array<long>, place int, size int, first boolean, far boolean, pivot long, pivots array<long>, key long, n int, component long"
    rows = stored(both.select("pivot", "pivots", "key", "n", "component", "grams", "centre_grams").mapInArrow(_differences(common), schema), f"{label}-differences")
    x, y = rows.where("first").alias("x"), rows.where("far").alias("y")
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    # the first shingle that two differences share has none before it, so what is left from there on must be enough
    enough = left * 2 * (top + bottom) >= (F.col("x.size") + F.col("y.size")) * (top + bottom) - (F.col("x.n") + F.col("y.n")) * (bottom - top)
    # on the first shingle only, of two that are both first and far once, and under the least of the centres that both have
    once = ~F.arrays_overlap("x.before", "y.before") & ~(F.col("x.far") & F.col("y.first") & (F.col("x.key") > F.col("y.key")))
    once &= F.array_min(F.array_intersect("x.pivots", "y.pivots")) == F.col("x.pivot")
    meet = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & _near_in_size("x.n", "y.n") & enough & once
    pairs = stored(_ordered(x.join(y, meet).select(F.col("x.key").alias("p"), F.col("y.key").alias("q")), "p", "q"), f"{label}-met")
    dropped(crowd, rows)
    return pairs


def near_components(docs: DataFrame, label: str = "near-copies") -> DataFrame:
    """doc_id, t1, t2 (of the text) and component of every row of ``docs``; columns doc_id, text."""
    with settings(docs.sparkSession, FEW_TEXTS):
        return _components(docs, label)


def _components(docs: DataFrame, label: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *text_key(F.col("text")))
    prints = stored(rows.mapInArrow(_banded, "doc_id long, t1 long, t2 long, k1 long, k2 long, n int, bands array<long>"), f"{label}-prints")
    once = prints.groupBy("k1", "k2").agg(F.min("n").alias("n"), F.min(F.struct("t1", "t2")).alias("t"), F.first("bands").alias("bands"))
    nodes = stored(once.select(F.monotonically_increasing_id().alias("key"), "k1", "k2", "n", "t.t1", "t.t2", "bands"), f"{label}-nodes")
    keyed = stored(nodes.select("key", "n", F.explode("bands").alias("band")), f"{label}-bands")
    met = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("key", "n")).alias("centre")).where("members > 1")
    cells = stored(keyed.join(met, "band"), f"{label}-cells")
    wanted = nodes.select("key", "t1", "t2").join(cells.select("key").distinct(), "key")
    texts = rows.select("t1", "t2", "text").join(wanted, ["t1", "t2"]).groupBy("key").agg(F.min("text").alias("text"))
    sets = stored(texts.mapInArrow(_sets, "key long, grams array<long>"), f"{label}-sets")

    stars = cells.where((F.col("key") != F.col("centre.key")) & _near_in_size("n", "centre.n"))
    starred = stored(_ordered(stars, "key", "centre.key"), f"{label}-stars")
    links = _verified(starred, sets, label)
    labels = least_labels(links, label)
    # bands whose members aren't all in one component yet
    placed = cells.join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "members", F.col("centre.key").alias("pivot"), "key", "n", F.coalesce("component", "key").alias("component"))
    placed = stored(placed, f"{label}-placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("band")
    rest = stored(placed.join(mixed, "band", "left_semi"), f"{label}-rest")
    x, y = rest.where(F.col("members") <= SMALL).alias("x"), rest.where(F.col("members") <= SMALL).alias("y")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _near_in_size("x.n", "y.n")
    few = _ordered(x.join(y, apart).select(F.col("x.key").alias("p"), F.col("y.key").alias("q")), "p", "q")
    many = _by_centre(rest.where((F.col("members") > SMALL) & (F.col("key") != F.col("pivot"))).select("pivot", "key", "n", "component").distinct(), sets, label)
    # what the stars have refused is known
    pairs = stored(few.union(many).distinct().join(starred, ["a", "b"], "left_anti"), f"{label}-pairs")
    more = _verified(pairs, sets, label)
    every = least_labels(links.unionByName(more), label)
    component = nodes.join(every.withColumnRenamed("node", "key"), "key", "left").select("k1", "k2", F.coalesce("component", "key").alias("component"))
    out = stored(prints.join(component, ["k1", "k2"]).select("doc_id", "t1", "t2", "component"), f"{label}-components")
    dropped(prints, nodes, keyed, cells, sets, starred, links, labels, placed, rest, many, pairs, more, every)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one of least id (null last), and the first by its text's hash
    of rows that share it. Documents without an id and documents that share one are apart if their texts are."""
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t1", "t2")
    keep = near_components(docs.select("doc_id", "text")).groupBy("component").agg(F.min(rank).alias("r"))
    # an id and a flag of none: equal in a join, which null ids aren't
    keys = ["none", "id", "t1", "t2"]
    keep = keep.select("r.none", F.coalesce("r.doc_id", F.lit(0)).alias("id"), "r.t1", "r.t2")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.isnull("doc_id").alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        *text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    )
    return keyed.join(keep, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
