"""Counts of n-grams of many texts in little space: grams meet as packed 80-bit keys, in passes, and only those that are asked for become words again.

A text is a row with its lines' tokens (``listed``). In each pass a task keys the grams of one range of the key space, adds up what it has of each, and ships sorted
keys as differences; a group of a language, a length and a part of the range folds them. The distinct grams of a corpus as strings are several times as large as
its texts, so they are never all there at once. Keys of 64 bits tell grams apart, 16 more bits that those weren't one by chance. Where grams are wanted as
words, a Bloom filter of their keys picks them out of the texts, and they are counted as words: what it lets through wrongly is told apart by that.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.sources.scratch import written

MAX_N = 3
#: Passes over the texts, each for a range of keys (a power of two), and words that a task adds up at once.
PASSES = 4
CHUNK = 2_000_000
#: Words whose grams become words at once, and rows that a Python worker is given at once.
FEW = 1_000_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1024"
#: Size of the filter that stands for wanted keys: 8 MB.
FILTER_BITS = 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "language string, n int, part int, keys binary, checks binary, counts binary, videos binary"


def listed(docs: DataFrame) -> DataFrame:
    """source_language, video_key, norm and surf: the tokens of a text's lines. ``docs``: doc_id, lang, text, a row for each id and language."""
    surf = F.transform(F.split("text", "\n"), lambda line: X.tokens(line))
    rows = docs.select(F.col("lang").alias("source_language"), F.col("doc_id").alias("video_key"), surf.alias("surf"))
    return rows.withColumn("norm", F.transform("surf", lambda line: F.transform(line, lambda t: X.normalize_token(t))))


def _hashed(column: str):
    return F.transform(column, lambda line: F.transform(line, lambda t: F.xxhash64(t)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def _chain(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A key for the run of ``n`` words from each on; the last n - 1 aren't runs."""
    size = len(words) - n + 1
    keys = _mixed(words[:size] ^ np.uint64(seed))
    for k in range(1, n):
        keys = _mixed((keys + np.uint64(seed | 1)) * _MIX ^ words[k : k + size])
    return keys


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a batch's words, the words left of each one's line, and its row."""
    docs = batch["h"]
    lines = docs.flatten()
    per_doc = pc.fill_null(pc.list_value_length(docs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    per_line = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    left = np.repeat(per_line.cumsum(), per_line) - np.arange(len(words))
    return words, left, np.repeat(np.repeat(np.arange(len(per_doc)), per_doc), per_line)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of some ``most`` words of whole rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch["h"].flatten().flatten())
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _order(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """By key and check, otherwise as it was; keys that differ by their check only are next to never there."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    return np.lexsort((checks, keys)) if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any() else order


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, without those that all are zero."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(data, np.uint8, offset=1)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def _signed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i4").tobytes(), 1)


def _packed(at: int, parts: int):
    """Rows of _PACKED of a batch's grams whose keys lie in the range of pass ``at``."""
    bits = np.uint64(PASSES.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, CHUNK):
            words, left, row = _flat(batch)
            languages = batch["language"].dictionary_encode()
            language = pc.fill_null(languages.indices, -1).to_numpy(zero_copy_only=False)
            known, sign = batch["known"].to_numpy(zero_copy_only=False), batch["sign"].to_numpy()
            out: list[list] = [[] for _ in range(7)]
            for n in range(1, MAX_N + 1):
                if len(words) < n:
                    continue
                keys = _chain(words, n, 0x5BD1E995)
                mine = left[: len(keys)] >= n
                if PASSES > 1:
                    mine &= keys >> (np.uint64(64) - bits) == at
                place = np.flatnonzero(mine)
                keys, checks, rows = keys[place], (_chain(words, n, 0x27D4EB2F)[place] >> np.uint64(48)).astype(np.uint16), row[place]
                for code in np.unique(language[rows]).tolist():
                    own = np.flatnonzero(language[rows] == code)
                    order = own[_order(keys[own], checks[own])]
                    k, c, r = keys[order], checks[order], rows[order]
                    new = _starts(k, c)
                    first = np.flatnonzero(new)
                    counts = np.add.reduceat(sign[r], first)
                    videos = np.add.reduceat((new | _starts(r)) * known[r] * sign[r], first)
                    k, c = k[first], c[first]
                    part = (((k << bits) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    edges = np.flatnonzero(_starts(part))
                    for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(k)], strict=True):
                        ahead = k[x:y] - np.concatenate([k[x : x + 1], k[x : y - 1]])
                        cells = (languages.dictionary[code].as_py() if code >= 0 else None, n, int(part[x]), k[x : x + 1].tobytes() + _planes(ahead), c[x:y].tobytes(), _signed(counts[x:y]), _signed(videos[x:y]))
                        for column, cell in zip(out, cells, strict=True):
                            column.append(cell)
            kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["language", "n", "part", "keys", "checks", "counts", "videos"])

    return run


def _folded(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a group, and their counts and videos; those of which nothing is left are gone."""
    keys = np.concatenate([np.frombuffer(b, "<u8", 1)[0] + np.cumsum(_unplaned(b[8:])) for b in table["keys"].to_pylist()])
    checks = np.concatenate([np.frombuffer(b, np.uint16) for b in table["checks"].to_pylist()])
    counts, videos = (np.concatenate([np.frombuffer(zlib.decompress(b), "<i4") for b in table[c].to_pylist()]).astype(np.int64) for c in ("counts", "videos"))
    order = _order(keys, checks)
    first = np.flatnonzero(_starts(keys[order], checks[order]))
    counts, videos = np.add.reduceat(counts[order], first), np.add.reduceat(videos[order], first)
    left = counts > 0
    return keys[order][first][left], counts[left], videos[left]


def _written(df: DataFrame, label: str) -> DataFrame:
    """Written with few rows at a time in Python's hands, for a row is a text."""
    conf = df.sparkSession.conf
    before = conf.get(_ROWS[0])
    conf.set(*_ROWS)
    try:
        return written(df, label)
    finally:
        conf.set(_ROWS[0], before)


def _passes(lists: DataFrame, fold, schema: str, label: str) -> list[DataFrame]:
    """``fold`` of each group, a table for each pass. ``lists``: source_language, video_key, norm, and sign where rows are taken away."""
    spark = lists.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sign = F.col("sign").cast("int") if "sign" in lists.columns else F.lit(1)
    out = []
    for at in range(PASSES):
        rows = lists.select(F.col("source_language").alias("language"), F.isnotnull("video_key").alias("known"), sign.alias("sign"), _hashed("norm").alias("h"))
        grouped = rows.mapInArrow(_packed(at, parts), _PACKED).groupBy("language", "n", "part")
        out.append(_written(grouped.applyInArrow(fold, schema), f"{label}-{at}"))
        # a pass's shuffle files go when the driver has let go of them
        del rows, grouped
        gc.collect()
        spark._jvm.System.gc()
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def summary(lists: DataFrame) -> DataFrame:
    """language, n, n_grams, total, top_count, video_pairs: of all grams."""

    def fold(table: pa.Table) -> pa.Table:
        keys, counts, videos = _folded(table)
        own = [table[c].slice(0, 1).combine_chunks() for c in ("language", "n")]
        sums = [[len(keys)], [int(counts.sum())], [int(counts.max(initial=0))], [int(videos.sum())]]
        return pa.Table.from_arrays([*own, *(pa.array(x, pa.int64()) for x in sums)], names=["language", "n", "n_grams", "total", "top_count", "video_pairs"])

    rows = _union(_passes(lists, fold, "language string, n int, n_grams long, total long, top_count long, video_pairs long", "gram-sums"))
    found = rows.groupBy("language", "n").agg(F.sum("n_grams").alias("n_grams"), F.sum("total").alias("total"), F.max("top_count").alias("top_count"), F.sum("video_pairs").alias("video_pairs"))
    return found.where("n_grams > 0")


def _keys(kept):
    def fold(table: pa.Table) -> pa.Table:
        keys, counts, videos = _folded(table)
        some = kept(counts, videos)
        return pa.table({"key": pa.array(keys[some].view(np.int64)), "videos": pa.array(videos[some])})

    return fold


def frequent(lists: DataFrame, least: int) -> DataFrame:
    """``tokens.gram_totals`` of the grams that occur ``least`` times or more."""
    wanted = _union(_passes(lists, _keys(lambda counts, videos: counts >= least), "key long, videos long", "gram-keys"))
    return _as_words(lists, wanted).where(F.col("total_count") >= least)


def most_spread(lists: DataFrame, top: int) -> DataFrame:
    """``tokens.gram_totals`` of grams among which are the ``top`` that the most videos have, of equal ones all."""

    def some(counts: np.ndarray, videos: np.ndarray) -> np.ndarray:
        return videos >= (np.partition(videos, -top)[-top] if len(videos) > top else 0)

    known = _union(_passes(lists, _keys(some), "key long, videos long", "gram-keys"))
    bound = known.orderBy(F.desc("videos")).limit(top).agg(F.count(F.lit(1)), F.min("videos")).first()
    least = bound[1] if bound[0] == top else 0
    while True:
        found = _as_words(lists, known.where(F.col("videos") >= least)).where(F.col("video_count") >= least)
        # grams whose keys were one by chance count for more together than each: then the bound was too high
        if not least or found.count() >= top:
            return found
        least = 0


def _filter(keys: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter over ``key``: at most FILTER_BITS / 64 rows reach the driver."""
    size = FILTER_BITS.bit_length() - 1
    at = keys.select(F.explode(F.array(*(F.shiftrightunsigned("key", k * size).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(2)))).alias("bit"))
    slots = at.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out, rows = np.zeros(FILTER_BITS // 64, np.int64), slots.toArrow()
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _met(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    size, out = FILTER_BITS.bit_length() - 1, np.ones(len(keys), bool)
    for k in range(2):
        at = (keys >> np.uint64(k * size)) & np.uint64(FILTER_BITS - 1)
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _worded(wanted):
    """Rows of the grams that the filter knows: as words, a row for each way that a chunk writes a gram; the first has its videos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, FEW):
            words, left, row = _flat(batch)
            norm, surf = (batch[c].flatten().flatten() for c in ("norm", "surf"))
            written_as = batch["s"].flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            languages = batch["language"].dictionary_encode()
            language = pc.fill_null(languages.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = batch["known"].to_numpy(zero_copy_only=False)
            for n in range(1, MAX_N + 1):
                if len(words) < n:
                    continue
                keys = _chain(words, n, 0x5BD1E995)
                place = np.flatnonzero((left[: len(keys)] >= n) & _met(keys, wanted.value))
                if not len(place):
                    continue
                keys, ways = keys[place], _chain(written_as, n, 0x5BD1E995)[place]
                order = np.lexsort((place, keys, language[row[place]]))
                k, r, lang = keys[order], row[place[order]], language[row[place[order]]]
                new = _starts(lang, k)
                videos = np.add.reduceat((new | _starts(r)) * known[r], np.flatnonzero(new))
                order = np.lexsort((ways, keys, language[row[place]]))
                k, way, lang = keys[order], ways[order], language[row[place[order]]]
                new = _starts(lang, k)
                first = np.flatnonzero(new | _starts(way))
                counts, spread = np.diff(np.append(first, len(k))), np.zeros(len(k), np.int64)
                spread[np.flatnonzero(new)] = videos
                at = place[order[first]]
                forms = [words_.take(pa.array(at)) if n == 1 else pc.binary_join_element_wise(*(words_.take(pa.array(at + i)) for i in range(n)), " ") for words_ in (norm, surf)]
                yield pa.RecordBatch.from_arrays(
                    [batch["language"].take(pa.array(row[at])), forms[0], pa.array(np.full(len(at), n, np.int32)), forms[1], pa.array(counts.astype(np.int64)), pa.array(spread[first])],
                    names=["language", "normalized", "n", "surface", "total_count", "video_count"],
                )

    return run


def _as_words(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    bits = lists.sparkSession.sparkContext.broadcast(_filter(wanted))
    rows = lists.select(F.col("source_language").alias("language"), F.isnotnull("video_key").alias("known"), "norm", "surf", _hashed("norm").alias("h"), _hashed("surf").alias("s"))
    found = rows.mapInArrow(_worded(bits), "language string, normalized string, n int, surface string, total_count long, video_count long")
    stats = found.groupBy("language", "normalized", "n").agg(F.min("surface").alias("surface"), F.sum("total_count").alias("total_count"), F.sum("video_count").alias("video_count"))
    return _written(stats, "gram-words")


def least_surfaces(lists: DataFrame) -> DataFrame:
    """language, n, least_surface: a token's characters all come after the blank, so the least gram starts with the least of the tokens that can start one."""

    def least(line, n: int):
        starts = F.slice(line, 1, F.greatest(F.size(line) - n + 1, F.lit(0)))
        first = F.array_min(starts)
        at = F.filter(F.transform(starts, lambda t, i: F.when(t == first, i)), lambda i: i.isNotNull())
        return F.array_min(F.transform(at, lambda i: F.array_join(F.slice(line, i + 1, n), " ")))

    every = F.array(*(F.struct(F.lit(n).alias("n"), F.array_min(F.transform("surf", lambda line: least(line, n))).alias("s")) for n in range(1, MAX_N + 1)))
    rows = lists.select(F.col("source_language").alias("language"), F.inline(every))
    return rows.where("s is not null").groupBy("language", "n").agg(F.min("s").alias("least_surface"))
