"""Token counts with overlap resynchronisation.

A document longer than a chunk is encoded in overlapping chunks, with offsets. Two neighbouring
chunks are spliced behind a token that both have, the same token at the same place. That such a
boundary is stable can be proven: a sequence of tokens is the encoding of its text exactly if each two
neighbours are the encoding of theirs; left of the boundary the pairs are the left chunk's, right of it
and across it (for the shared token is also the right chunk's) they are the right chunk's. Tokens at a
word's end differ from those inside it, so a shared token also tells that both chunks are at the same place of
a word, and the white space between words starts anew in any case. If the overlap has no shared token it is
widened, and if the whole chunk has none, the chunk is made twice as long, so the work stays in proportion to the
text whatever it consists of; text without blanks needs no more than other text.

A document of one chunk has nothing to splice. White space is a boundary of the same kind, as the tokenizer drops
it before it merges, so a worker counts each different stretch between blanks once and remembers it, within a bound.

A null text is empty and has no tokens. Repeated rows, null ids and an empty table need
nothing special. Other columns aren't read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexispan.llm.common import documents

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Characters of a chunk, and of its first overlap.
CHUNK = 32_768
OVERLAP = 256
#: Stretches that a worker remembers before it starts anew.
REMEMBERED = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


Token = tuple[int, int, int]


def _tokens(own, text: str, start: int, end: int) -> list[Token]:
    """Start and end in the whole text, and id, of the tokens of text[start:end]."""
    found = own.encode(text[start:end], add_special_tokens=False)
    return [(start + s, start + e, i) for (s, e), i in zip(found.offsets, found.ids, strict=True)]


def _ends(tokens: list[Token], start: int) -> dict[int, list[Token]]:
    """Places behind ``start`` where a token ends and none goes on, with the tokens that end there (more than one if
    a character takes several)."""
    out: dict[int, list[Token]] = {}
    for k, token in enumerate(tokens):
        if token[0] >= start:
            out.setdefault(token[1], []).append(token)
            if k + 1 < len(tokens) and tokens[k + 1][0] < token[1] != tokens[k + 1][1]:
                del out[token[1]]
    return out


def _splice(left: list[Token], right: list[Token], start: int, end: int) -> int | None:
    """The last place in the overlap, from ``start`` to ``end``, behind a token that both have."""
    a, b = _ends(left, start), _ends([t for t in right if t[0] < end], start)
    return max((at for at, tokens in a.items() if at <= end and b.get(at) == tokens), default=None)


def count_in_chunks(own, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text that is encoded a chunk at a time. An overlap holds the longest special string, so that a chunk
    that starts inside one meets the chunk before that has it whole."""
    overlap = max(overlap, *(len(t.content) for t in own.get_added_tokens_decoder().values()), 1)
    total, begin, start = 0, 0, 0  # tokens before ``begin`` are counted; the present chunk starts at ``start``
    end = min(len(text), chunk)
    tokens = _tokens(own, text, start, end)
    while end < len(text):
        wide, at = overlap, None
        while at is None and end - wide > start:
            following, stop = end - wide, min(len(text), end + chunk)
            more = _tokens(own, text, following, stop)
            at = _splice(tokens, more, max(following, begin), end)
            wide *= 4
        if at is None:  # nothing shared in all of the chunk
            end = min(len(text), start + 2 * (end - start))
            tokens = _tokens(own, text, start, end)
        else:
            total += sum(begin <= s < at for s, _, _ in tokens)
            begin, start, end, tokens = at, following, stop, more
    return total + sum(begin <= s for s, _, _ in tokens)


class Counter:
    def __init__(self, path: str) -> None:
        self.own = _tokenizer(path)
        self.seen: dict[bytes, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        huge = {k for k, t in enumerate(texts) if len(t) > CHUNK}
        stretches = [[] if k in huge else t.encode().split() for k, t in enumerate(texts)]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        fresh = list(set().union(*stretches).difference(self.seen))
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            found = self.own.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.seen.update(zip(some, map(len, found), strict=True))
        known = self.seen.__getitem__
        return [count_in_chunks(self.own, t) if k in huge else sum(map(known, stretches[k])) for k, t in enumerate(texts)]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = _counter(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or "" for t in part["text"].to_pylist()]
            counts = own.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > TOKEN_LIMIT for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(lambda b: _counted(b, path), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
