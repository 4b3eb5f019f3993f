"""Exact search for windows of a text that occur elsewhere, as rows that Spark groups.

A text is a sequence of tokens (bytes, or words of the text joined by single spaces).
A window is ``length`` consecutive tokens. Inside each window the ``reach`` positions
from its start on hold one position of least rolling hash: the window's anchor, or trigger.
It depends on the window's own content only, so equal windows have equal anchors at equal
offsets. Consecutive windows with one anchor form a unit.

1. Seeds. Each unit has a 64-bit seed of tokens that follow its anchor and that all its
   windows have. A unit whose seed is found once has no window that occurs elsewhere. Seeds
   only rule out: what they bring together is compared by content afterwards.
2. The units left are described by 128-bit hashes of their content,
   ``key a``, of the tokens that all windows with this anchor have in common, and
   ``key u``, of all the unit's tokens and of its place around the anchor.
   A unit whose key u is found twice has only windows that occur elsewhere.
3. The few whose key a is shared while key u isn't (edges of repeated passages) are cut into
   smaller units around the same anchor, down to single windows.

Each step is a hash aggregation and an equality join of keys, so a passage in a million
documents costs a million rows, never their pairs, and no group is gathered in a task. All
of it works on distinct texts; a text that has a copy is repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import FEW_TEXTS, KEY, distinct_texts, dropped, settings, sized, stored

SEED_SCHEMA = "t1 long, t2 long, lo array<int>, hi array<int>, anchor array<int>, seed array<long>"
UNIT_SCHEMA = "a1 long, a2 long, u1 long, u2 long, t1 long, t2 long, lo int, hi int, anchor int"
#: Windows handled at a time; longer texts are cut, with the overlap that windows need.
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Layout:
    """length: tokens of a window; reach: start positions of which one is the anchor; gram: tokens hashed for it;
    steps: unit sizes to which undecided units are cut, the last is 1; words: tokens are words, not bytes;
    seeds: of a text's pieces (see ``Piece``) and the units' anchors, a hash for each unit."""

    length: int
    reach: int
    gram: int
    steps: tuple[int, ...]
    words: bool
    seeds: Callable[[Piece], np.ndarray]

    @property
    def common(self) -> int:
        return self.length - self.reach + 1


@dataclass(frozen=True)
class Piece:
    """A stretch of a text: its bytes, where its tokens start and end, all triggers with their hashes, and those triggers
    that are units' anchors."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    triggers: np.ndarray
    hashes: np.ndarray
    anchors: np.ndarray
    layout: Layout


def tokens(text: str | None, layout: Layout) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text as bytes, and where its tokens start and end."""
    data = (text or "").encode()
    if not layout.words:
        starts = np.arange(len(data), dtype=np.int64)
        return data, starts, starts + 1
    data = b" ".join(data.split())
    if not data:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    return data, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))


def _gram_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, layout: Layout) -> np.ndarray:
    """A 64-bit hash for each run of ``gram`` tokens."""
    raw = np.frombuffer(data, np.uint8)
    if not layout.words:
        wide, have = raw.astype(np.uint64), 1
        while have < layout.gram:
            wide = wide[:-have] | (wide[have:] << np.uint64(8 * have))
            have *= 2
    else:
        base = np.uint64(0x100000001B3)
        n = len(raw) + 1
        powers = np.cumprod(np.full(n, base, np.uint64)) if n else raw
        inverse = np.cumprod(np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
        word = (sums[ends] - sums[starts]) * inverse[starts]
        wide = word
        for k in range(1, layout.gram):
            wide = wide[:-1] * _MIX + word[k:]
    wide = (wide ^ (wide >> np.uint64(29))) * _MIX
    return (wide ^ (wide >> np.uint64(32))) * _MIX


def _anchors(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each start, the first position of least hash among the next ``reach``."""
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def units_of(text: str | None, layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """lo, hi, anchor and seed of the units of one text, a piece at a time."""
    data, starts, ends = tokens(text, layout)
    n = len(starts) - layout.length + 1
    for at in range(0, max(n, 0), PIECE):
        count = min(PIECE, n - at)
        last = at + count + layout.length - 1
        base = int(starts[at])
        s, e = starts[at:last] - base, ends[at:last] - base
        piece = data[base : int(ends[last - 1])]
        hashes = _gram_hashes(piece, s, e, layout) >> np.uint64(32)
        every = _anchors(hashes << np.uint64(32), layout.reach)
        anchor = every[:count]
        lo = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        hi = np.concatenate((lo[1:] - 1, [count - 1]))
        triggers = every[np.concatenate(([True], np.diff(every) != 0))]
        b = anchor[lo]
        yield lo + at, hi + at, b + at, layout.seeds(Piece(piece, s, e, triggers, hashes[triggers], b, layout))


def following_tokens(piece: Piece) -> np.ndarray:
    """Seeds: the tokens from an anchor on that all its windows have."""
    view, digest, b = memoryview(piece.data), xxhash.xxh3_64_intdigest, piece.anchors
    pairs = zip(piece.starts[b].tolist(), piece.ends[b + piece.layout.common - 1].tolist(), strict=True)
    return _signed([digest(view[x:y]) for x, y in pairs])


class _Columns:
    """Rows of UNIT_SCHEMA, gathered."""

    def __init__(self) -> None:
        self.keys: list[list[bytes]] = [[], []]
        self.rest: list[list[int]] = [[] for _ in range(5)]

    def add(self, data: bytes, starts: np.ndarray, ends: np.ndarray, key: tuple[int, int], units: list[tuple[int, int, int, int, int]], length: int) -> None:
        """``units``: first and last window, anchor, and the first and last token that its windows have in common."""
        view, digest = memoryview(data), xxhash.xxh3_128_digest
        s, e = starts, ends
        for lo, hi, b, first, last in units:
            self.keys[0].append(digest(view[s[first] : e[last]], b - first))
            self.keys[1].append(digest(view[s[lo] : e[hi + length - 1]], (b - lo) << 24 | (hi - lo)))
            for column, value in zip(self.rest, (*key, lo, hi, b), strict=True):
                column.append(value)

    def batch(self) -> pa.RecordBatch:
        halves = [np.frombuffer(b"".join(k), "<i8").reshape(-1, 2) for k in self.keys]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        columns = [pa.array(np.ascontiguousarray(h[:, k])) for h in halves for k in (0, 1)]
        columns += [pa.array(c, t) for c, t in zip(self.rest, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["a1", "a2", "u1", "u2", "t1", "t2", "lo", "hi", "anchor"])


def smaller_units(units: list[tuple[int, int, int]], step: int, layout: Layout) -> list[tuple[int, int, int, int, int]]:
    """The given units (lo, hi, anchor) cut to at most ``step`` windows (0: not cut); a cut depends on the distance to the
    anchor only. With each the first and last token that all windows have which such a cut could hold."""
    if not step:
        return [(lo, hi, b, b, b + layout.common - 1) for lo, hi, b in units]
    cut = []
    for lo, hi, b in units:
        for t in range((b - hi) // step, (b - lo) // step + 1):
            # windows that start t * step to t * step + step - 1 tokens before the anchor
            first, last = max(lo, b - t * step - step + 1), min(hi, b - t * step)
            cut.append((first, last, b, b - t * step, b - t * step - step + layout.length))
    return cut


def _seeds(layout: Layout) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, lists = ([], []), ([], [], [], [])
                for text, *key in zip(part["text"], part["t1"].to_pylist(), part["t2"].to_pylist(), strict=True):
                    for found in units_of(text.as_py(), layout):
                        for out, value in zip((*keys, *lists), (*key, *found), strict=True):
                            out.append(value)
                columns = [pa.array(k, pa.int64()) for k in keys]
                columns += [pa.array([v.astype(t.value_type.to_pandas_dtype()) for v in x], t) for x, t in zip(lists, (ints, ints, ints, longs), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "lo", "hi", "anchor", "seed"])

    return run


def _keyed(layout: Layout, step: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Columns()
            for text, units, *key in zip(batch["text"], batch["units"], batch["t1"].to_pylist(), batch["t2"].to_pylist(), strict=True):
                data, starts, ends = tokens(text.as_py(), layout)
                starts, ends = starts.tolist(), ends.tolist()
                units = [(u["lo"], u["hi"], u["anchor"]) for u in units.as_py()]
                for at in range(0, len(units), 2_000):
                    out.add(data, starts, ends, tuple(key), smaller_units(units[at : at + 2_000], step, layout), layout.length)
                    if len(out.rest[0]) > 50_000:
                        yield out.batch()
                        out = _Columns()
            if out.rest[0]:
                yield out.batch()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjacent start intervals of each text made one."""
    for batch in batches:
        lows, highs = [], []
        for found in batch["units"].to_pylist():
            lo, hi = [], []
            for x, y in sorted((u["lo"], u["hi"]) for u in found):
                if lo and x <= hi[-1] + 1:
                    hi[-1] = max(hi[-1], y)
                else:
                    lo.append(x)
                    hi.append(y)
            lows.append(lo)
            highs.append(hi)
        yield pa.RecordBatch.from_arrays(
            [batch["t1"], batch["t2"], pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))],
            names=["t1", "t2", "lows", "highs"],
        )


def _units(texts: DataFrame, chosen: DataFrame, layout: Layout, step: int, label: str) -> DataFrame:
    """Keys of the chosen units (t1, t2, lo, hi, anchor), cut to ``step``."""
    chosen = stored(chosen.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("units")), f"{label}-chosen")
    weight = chosen.agg(F.sum(F.size("units") * 12 + 24).alias("bytes")).first()["bytes"] or 0
    joined = texts.select(*KEY, "text").join(sized(chosen, weight), KEY)
    units = stored(joined.select(*KEY, "text", "units").mapInArrow(_keyed(layout, step), UNIT_SCHEMA), f"{label}-units")
    dropped(chosen)
    return units


def repeated_windows(texts: DataFrame, layout: Layout, label: str) -> DataFrame:
    """Starts of all windows that occur elsewhere: t1, t2, lows, highs, of texts that have some.

    ``texts``: t1, t2, text, distinct. Windows that occur in a copy of the same text only aren't reported."""
    where = [*KEY, "lo", "hi"]
    parse = stored(texts.select(*KEY, "text").mapInArrow(_seeds(layout), SEED_SCHEMA), f"{label}-parse")
    one = F.explode(F.arrays_zip("lo", "hi", "anchor", "seed")).alias("u")
    rows = parse.select(*KEY, one).select(*KEY, "u.lo", "u.hi", "u.anchor", "u.seed")
    seeds = stored(rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), f"{label}-seeds")
    units = _units(texts, rows.join(seeds, "seed").select(*where, "anchor"), layout, 0, label)
    dropped(parse, seeds)
    found, used = [], []
    for step in (*layout.steps, 0):
        limits = [f(c).alias(f"{f.__name__}_{c}") for c in ("u1", "u2") for f in (F.min, F.max)]
        groups = units.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("n"), *limits)
        # stored, so that both sides of the join are plain exchanges, whose hot partitions Spark splits
        groups = stored(groups.where("n > 1").drop("n"), f"{label}-groups")
        shared = stored(units.join(groups, ["a1", "a2"]), f"{label}-shared")
        dropped(units, groups)
        alike = (F.col("min_u1") == F.col("max_u1")) & (F.col("min_u2") == F.col("max_u2"))
        found.append(shared.where(alike).select(*where))
        mixed = shared.where(~alike)
        keys = ["a1", "a2", "u1", "u2"]
        kinds = mixed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*where, "anchor")).alias("unit"))
        kinds = stored(kinds, f"{label}-kinds")
        used += [shared, kinds]
        found.append(mixed.join(kinds.where("n > 1").select(*keys), keys).select(*where))
        if step:
            units = _units(texts, kinds.select("unit.*"), layout, step, label)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    lists = every.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("units"))
    starts = stored(lists.mapInArrow(_merged, "t1 long, t2 long, lows array<int>, highs array<int>"), f"{label}-starts")
    dropped(*used)
    return starts


def covered(lows: list[int] | None, highs: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal token runs [start, end) that the windows cover."""
    runs: list[tuple[int, int]] = []
    for lo, hi in zip(lows or (), highs or (), strict=True):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], hi + length)
        else:
            runs.append((lo, hi + length))
    return runs


def by_repeats(docs: DataFrame, layout: Layout, label: str, result: Callable, schema: str) -> DataFrame:
    """What ``result`` (Arrow batches to batches) makes of t1, t2, copies, text, lows, highs of every distinct text, stored."""
    with settings(docs.sparkSession, FEW_TEXTS):
        texts = distinct_texts(docs, f"{label}-texts")
        starts = repeated_windows(texts, layout, label)
        found = stored(texts.join(starts, KEY, "left").mapInArrow(result, schema), f"{label}-results")
    dropped(texts, starts)
    return found


def removed_runs(copies: int, lows: list[int] | None, highs: list[int] | None, n: int, length: int) -> list[tuple[int, int]]:
    """Token runs [start, end) to remove of a text of ``n`` tokens."""
    if copies > 1:
        return [(0, n)] if n >= length else []
    return covered(lows, highs, length)

