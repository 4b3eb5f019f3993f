"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list of parts. The start of every adjacent pair that has a
merge rank lies in that rank's bucket, and three levels of 64-bit bitmaps say which buckets
hold something: find-first-set on each level gives the lowest rank in constant time,
whatever the pre-token's length. A popped start whose pair has changed since is stale and
skipped. Equal ranks leave a bucket from left to right, as the reference library merges them.

Texts stay in their partitions: no shuffle. Pre-tokens that a worker has seen are looked up
in a table of bounded size. Vocabulary files are read on the executors from a path that is
a parameter; they aren't part of the repository.

A null text is empty: no tokens, and the hashes of nothing. Repeated rows, null ids and an
empty table need nothing special; other columns aren't read. Texts of any length are cut into
pre-tokens lazily.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from lexispan.llm.common import documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1_200_000
#: Characters beyond which a text's pre-tokens aren't listed at once.
LONG = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token.

    The queue: ``buckets`` holds places by rank, as heaps; bit r of ``low``, w = r // 64 of ``middle`` and b = w // 64 of
    ``top`` are set while something lies below them. It lives in local names, for most pre-tokens are short."""
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    current = [-1] * n  # rank of the pair that starts here
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    middle: dict[int, int] = {}
    top = 0

    fresh = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    while True:
        for rank, i in fresh:
            current[i] = rank
            if rank in buckets:
                heappush(buckets[rank], i)
            else:
                buckets[rank] = [i]
                word = rank >> 6
                block = rank >> 12
                if word in low:
                    low[word] |= 1 << (rank & 63)
                else:
                    low[word] = 1 << (rank & 63)
                    middle[block] = middle.get(block, 0) | 1 << (word & 63)
                    top |= 1 << block
        fresh = []
        if not top:
            break
        # find-first-set down the levels
        block = (top & -top).bit_length() - 1
        bits = middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                low[word] = bits
            else:
                del low[word]
                bits = middle[block]
                bits &= bits - 1
                middle[block] = bits
                if not bits:
                    top &= top - 1
        if current[i] != rank:
            continue  # stale
        j = end[i]
        k = end[j]
        end[i] = k
        current[i] = current[j] = -1
        if k < n:
            before[k] = i
            if (rank := rank_of(piece[i : end[k]])) is not None:
                fresh.append((rank, i))
        h = before[i]
        if h >= 0:
            current[h] = -1
            if (rank := rank_of(piece[h:k])) is not None:
                fresh.append((rank, h))
    ids, i = [], 0
    while i < n:
        k = end[i]
        ids.append(ranks[piece[i:k]])
        i = k
    return ids


class Coder:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, bytes] = {}

    def _missing(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[piece] = ids
        return ids

    def _packed(self, pieces: list[str]) -> bytes:
        seen, missing = self.seen.get, self._missing
        return b"".join([seen(p) or missing(p) for p in pieces])

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in runs."""
        if len(text) <= LONG:
            yield self._packed(self.pattern.findall(text))
            return
        for some in batched((m.group() for m in self.pattern.finditer(text)), 1 << 16):
            yield self._packed(list(some))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = coder(path)
    for batch in batches:
        counts, ids, texts = [], [], []
        for text in batch["text"]:
            n, packed_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for packed in own.encode(text.as_py() or ""):
                n += len(packed) // 4
                packed_hash.update(packed)
                text_hash.update(own.decode(packed))
            counts.append(n)
            ids.append(packed_hash.hexdigest())
            texts.append(text_hash.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = coder(path)
    for batch in batches:
        lists = [np.frombuffer(b"".join(own.encode(t.as_py() or "")), "<u4").astype(np.int32) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = coder(path)
    for batch in batches:
        texts = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode(errors="replace") for x in batch["ids"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])


def _of_documents(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of every text."""
    path = path or public_tokenizers.path(VOCABULARY)
    return _of_documents(docs).mapInArrow(lambda b: _ids(b, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of every list of token ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _texts(b, path), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each text encoded and decoded again: number of ids, and hashes of the ids and of the decoded bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _of_documents(docs).mapInArrow(lambda b: _coded(b, path), schema)


def op2_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
