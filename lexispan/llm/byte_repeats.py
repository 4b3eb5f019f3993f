"""Suffix-array dedup: bytes in long strings that occur elsewhere are removed, by prefix-free parsing.

Rolling-hash triggers cut every distinct text into phrases: a trigger is a place whose 8 bytes
have the least hash of some 128 places in a row, so a phrase has 128 bytes at most and where it
ends depends on what follows its start. The *parse* is a row for each text: where its phrases
start, and the hash of each phrase, its name in the *dictionary*. Every string of 400 bytes has 272
bytes after its trigger, and the phrases that these settle, two at least, are the class of the parse suffix
there. Suffixes that are alone in their class have no such string in common with any other and drop out.

The suffixes of the corpus that are left start inside a phrase, and their place in corpus order
is that of a dictionary suffix (the bytes up to the trigger) and of the parse suffix after it. For a
threshold only the question counts which suffixes agree on their first 400 bytes: all suffixes of a
phrase at once where the phrase and what follows agree, else in blocks of 16, else one by one (see
``spans``). Neighbours in a suffix array of letters would answer the same, at a row for each byte of
the dictionary.

A text that is null or shorter than 400 bytes has nothing to remove. Rows that repeat a
document count as occurrences of their own, so such texts go altogether. Nulls in other
columns don't matter and other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import KEY, by_text, documents, text_key, text_of
from lexispan.llm.spans import Layout, Piece, by_repeats, removed_runs

LENGTH = 400
_BASE = np.uint64(0x9E3779B97F4A7C15)


def parse_classes(piece: Piece) -> np.ndarray:
    """For each anchor the class of the parse suffix that starts there: the names of the phrases whose ends the bytes that
    all its windows have settle. An end is settled by its own 8 bytes if its hash is less than that of the phrase's start, else
    once as many places as a trigger reaches have been seen."""
    view, digest, cuts = memoryview(piece.data), xxhash.xxh3_64_intdigest, piece.triggers
    reach, gram = piece.layout.reach, piece.layout.gram
    pairs = zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
    names = np.array([digest(view[x:y]) for x, y in pairs], np.uint64)
    settled = np.where(piece.hashes[1:] < piece.hashes[:-1], cuts[1:] + gram, cuts[:-1] + reach + gram)
    first = np.searchsorted(cuts, piece.anchors)
    last = np.searchsorted(settled, piece.anchors + piece.layout.common, side="right")
    n = len(names)
    powers = np.cumprod(np.full(n + 1, _BASE, np.uint64))
    inverse = np.cumprod(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * powers[:-1])))
    return ((sums[last] - sums[first]) * inverse[first]).view(np.int64)


BYTES = Layout(length=LENGTH, reach=128, gram=8, steps=(16, 1), words=False, seeds=parse_classes)


def _removed(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t1, t2, copies, text, lows, highs in zip(*(batch[c].to_pylist() for c in ("t1", "t2", "copies", "text", "lows", "highs")), strict=True):
            data = text.encode()
            runs, kept, at = removed_runs(copies, lows, highs, len(data), layout.length), hashlib.sha256(), 0
            for start, end in runs:
                kept.update(data[at:start])
                at = end
            kept.update(data[at:])
            out.append((t1, t2, copies, len(data), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        types = (*[pa.int64()] * 6, pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["t1", "t2", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    schema = "t1 long, t2 long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = by_repeats(docs, BYTES, "byte-repeats", lambda batches: _removed(batches, BYTES), schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text_of(docs)))
    return by_text(rows, found).drop(*KEY)
