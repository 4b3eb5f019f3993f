"""Substring dedup by seed and extend over words.

Seeds are winnowed anchors: of any 16 neighbouring word pairs the one of least hash is
kept, so every window of 35 words holds an anchor that its own words determine. Documents
meet on the words from an anchor on (the seed); seeds that are found once are dropped. A
seed's match is extended both ways by comparing how far its surroundings are shared: the
whole stretch around the anchor first, then window by window at the edges of a repeat
(see ``spans``), which gives the same maximal repeats as extending every pair, without
making the pairs. Words within a repeat of 35 words or more are removed.

A null or blank text has no words. Repeated rows count as occurrences of their own. Other
columns are passed through by ``without_repeats`` and otherwise not read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import KEY, by_text, documents, text_key, text_of
from lexispan.llm.spans import Layout, by_repeats, following_tokens, removed_runs

LENGTH = 35
WORDS = Layout(length=LENGTH, reach=16, gram=2, steps=(1,), words=True, seeds=following_tokens)


def kept_words(text: str | None, copies: int, lows: list[int] | None, highs: list[int] | None, length: int) -> tuple[int, int, str]:
    """Number of words, number removed, and the rest joined by single spaces."""
    words = (text or "").encode().split()
    rest, at = [], 0
    for start, end in removed_runs(copies, lows, highs, len(words), length):
        rest += words[at:start]
        at = end
    rest += words[at:]
    return len(words), len(words) - len(rest), b" ".join(rest).decode()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in ("text", "copies", "lows", "highs")), strict=True)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [kept_words(*row, LENGTH) for row in _rows(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch["t1"], batch["t2"], batch["copies"],
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out], pa.string()),
            ],
            names=["t1", "t2", "copies", "n_words", "n_removed", "kept_sha256"],
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that lose words, without them, and (null) those that have copies and don't."""
    for batch in batches:
        found = [(k, kept_words(*row, LENGTH)) for k, row in enumerate(_rows(batch))]
        changed = [(k, x[2] if x[1] else None) for k, x in found if x[1] or batch["copies"][k].as_py() > 1]
        part = batch.take(pa.array([k for k, _ in changed], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [part["t1"], part["t2"], part["copies"], pa.array([x for _, x in changed], pa.string())], names=["t1", "t2", "copies", "cleaned"]
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words removed from ``text``; a text that has none stays as it is, to the byte, and a
    document of which nothing is left stays, with an empty text."""
    cleaned = by_repeats(docs, WORDS, "word-repeats", _cleaned, "t1 long, t2 long, copies long, cleaned string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = by_text(docs.select(row, *text_key(text_of(docs))), cleaned)
    text = F.coalesce("cleaned", F.col("row.text").cast("string"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    schema = "t1 long, t2 long, copies long, n_words long, n_removed long, kept_sha256 string"
    found = by_repeats(docs, WORDS, "word-repeats", _removed, schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text_of(docs)))
    return by_text(rows, found).drop(*KEY)
