r"""Phrase collocations by set-oriented relational mining.

Phrases of two and three adjacent words are mined from relations of occurrences, as SETM does for item sets:

1. ``R1``, the occurrences of words, is persisted in buckets of the text and sorted by text and place; words that aren't frequent are left out.
2. ``R2`` is the merge join of ``R1`` with itself on text and adjacent place, persisted in the same order; groups of equal words are counted.
3. Occurrences of groups that aren't frequent leave ``R2`` by a semi-join before it is merge-joined with itself to phrases of three words, which are counted.

Buckets and order carry over from relation to relation, so the merge joins shuffle nothing; Spark sorts the side that is moved by a place again, in
which it finds all rows in order. Only partial counts of groups are shuffled. Frequent words and pairs are known by Bloom filters of fixed size
(``FILTER_BITS``): what they let through wrongly never gets a count of ``LEAST`` later, for a phrase is no more frequent than its parts. So they can't
change a result, and what is broadcast doesn't grow.

Words: A-Z are lower-cased, texts are split at ``[.,;:!?\x0A-\x0D]`` into pieces, pieces at spaces and tabs. A place counts words and skips one
between pieces, so adjacent places never cross one. Languages are counted apart; a word's key is a 64-bit hash of language and word. The lexicon
is searched for words that share a key, and the seed is changed until there are none: keys stand for words exactly.

Texts are counted once for all their copies (known by 128 bits of hash). A null text has no words; a null language is ``und``, as is one of that name. Repeated rows are
occurrences like any other; ids and other columns aren't read. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.llm.common import KEY, bucketed, documents, dropped, settings, stored, text_key, text_of

LEAST = 10
#: A phrase goes if a longer candidate that holds it has this share of its count, in percent.
COVER_PERCENT = 50
TOP = 2_000
SCALE = 1_000_000
#: A language's candidates are ranked in so many pieces first; the task of the language gets the first of each only.
PIECES = 64
#: Size of a filter that stands for the frequent words or pairs of words: 8 MB.
FILTER_BITS = 1 << 26

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(46 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = 1 << 17
#: Bytes of text whose words are keyed at once.
_STRETCH = 1 << 18
#: Words of more bytes are keyed one by one.
_LONG = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: The merge joins' inputs lie in buckets of fewer keys than are joined on, each a sorted file.
_MERGE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def words_of(text: str) -> list[bytes]:
    """Words in order."""
    return text.encode().translate(_TABLE).replace(b".", b" ").split()


def word_key(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed) - (1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def keyed_words(texts: list[bytes], langs: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of translated texts the number of its text, its place and its key. A place counts words and breaks.
    Words are hashed eight bytes at a time, all of them at once."""
    data = b".".join(texts)
    raw = np.frombuffer(data, np.uint8)
    breaks = raw == 46
    edges = np.diff(np.concatenate(([True], breaks | (raw == 32), [True])).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    size = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    keys = _mixed(size.astype(np.uint64) ^ np.array([word_key(lang, b"", seed) for lang in langs], np.int64).view(np.uint64)[text])
    now, at, left = np.arange(len(starts)), starts, size
    while len(now):
        part = eights[at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))
        keys[now] = _mixed(keys[now] ^ part)
        more = (left > 8) & (size[now] <= _LONG)
        now, at, left = now[more], at[more] + 8, left[more] - 8
    keys = keys.view(np.int64)
    for i in np.flatnonzero(size > _LONG).tolist():
        keys[i] = word_key(langs[text[i]], data[starts[i] : ends[i]], seed)
    return text, np.arange(len(starts)) + np.searchsorted(np.flatnonzero(breaks), starts), keys


def _lexicon(seed: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, copies, text in zip(batch["lang"].to_pylist(), batch["copies"].to_pylist(), batch["text"], strict=True):
                counts = by_lang.setdefault(lang, Counter())
                if copies == 1:
                    counts.update(words_of(text.as_py()))
                else:
                    for word, n in Counter(words_of(text.as_py())).items():
                        counts[word] += n * copies
            for lang, counts in by_lang.items():
                words, ns = list(counts), list(counts.values())
                for at in range(0, len(words), _ROWS):
                    some = words[at : at + _ROWS]
                    columns = [pa.array(keyed_words([b" ".join(some)], [lang], seed)[2]), pa.array([lang] * len(some), pa.string())]
                    columns += [pa.array(some, pa.string()), pa.array(ns[at : at + _ROWS], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["w", "lang", "word", "n"])

    return counted


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[list[list[int]], list[str], list[bytes]]]:
    """Texts in order, some ``_STRETCH`` bytes at a time: their keys and copies, their languages, and themselves translated."""
    rows, langs, texts, size = [], [], [], 0
    for *row, lang, text in zip(*(batch[c].to_pylist() for c in (*KEY, "copies", "lang")), batch["text"], strict=True):
        rows.append(row)
        langs.append(lang)
        texts.append(text.as_py().encode().translate(_TABLE))
        size += len(texts[-1])
        if size >= _STRETCH:
            yield rows, langs, texts
            rows, langs, texts, size = [], [], [], 0
    if texts:
        yield rows, langs, texts


def _occurrences(seed: int, frequent: Broadcast):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for rows, langs, texts in _stretches(batch):
                text, at, keys = keyed_words(texts, langs, seed)
                kept = _known(frequent.value, keys.view(np.uint64))
                of = np.array(rows, np.int64)[text[kept]]
                for c, v in zip(columns, (*of.T, at[kept].astype(np.int32), keys[kept]), strict=True):
                    c.append(v)
                if sum(map(len, columns[4])) >= _ROWS:
                    yield _batch(columns)
                    columns = [[] for _ in range(5)]
            yield _batch(columns)

    return placed


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int64)
    arrays = [pa.array(np.concatenate([np.empty(0, kind), *c])) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[*KEY, "copies", "at", "w"])


def _sorted_relation(df: DataFrame, label: str) -> DataFrame:
    return bucketed(df, KEY, label, order=[*KEY, "at"])


def _adjacent(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` joined to those of ``right`` that lie one place further in the same text; ``right`` has the columns t1, t2, at and one more."""
    (word,) = [c for c in right.columns if c not in (*KEY, "at")]
    x, y = left.alias("x"), right.alias("y")
    met = x.join(y, F.expr("x.t1 = y.t1 and x.t2 = y.t2 and x.at + 1 = y.at"))
    return met.select(*(F.col(f"x.{c}").alias(c) for c in left.columns), F.col(f"y.{word}").alias(word))


def _filter(rows: DataFrame, bits: Column) -> np.ndarray:
    """The bits of a Bloom filter over 64-bit hashes: at most FILTER_BITS / 64 rows reach the driver, whatever the input."""
    slots = rows.select(F.explode(F.array(*_places(bits))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("slot"))
    slots = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return out


def _places(bits: Column) -> list[Column]:
    size = FILTER_BITS.bit_length() - 1
    return [F.shiftrightunsigned(bits, k * size).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(2)]


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter knows."""
    size, flags, hit = FILTER_BITS.bit_length() - 1, bits.view(np.uint8), np.ones(len(hashes), bool)
    for k in range(2):
        at = (hashes >> np.uint64(k * size)) & np.uint64(FILTER_BITS - 1)
        hit &= (flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def _let_through(pairs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows of ``pairs`` (columns w1, w2, ...) that the filter knows, which is a relation of one row here."""
    one = pairs.sparkSession.createDataFrame(pa.table({"known": pa.array([bits], pa.list_(pa.int64()))}))
    hit = [F.expr(f"shiftright(get(known, cast(bit{k} >> 6 as int)), cast(bit{k} & 63 as int)) & 1 = 1") for k in range(2)]
    placed = pairs.withColumn("bits", F.xxhash64("w1", "w2"))
    placed = placed.select(*pairs.columns, *(c.alias(f"bit{k}") for k, c in enumerate(_places(F.col("bits")))))
    return placed.join(F.broadcast(one), hit[0] & hit[1], "left_semi").select(*pairs.columns)


def _score(a: str, x: str, y: str) -> Column:
    """floor(SCALE * a * a / (x * y)) in decimals of 38 digits, which hold it for counts below 10 ** 16."""
    wide = lambda c: f"cast({c} as decimal(18, 0))"
    return F.expr(f"({wide(a)} * {wide(a)} * cast({SCALE} as decimal(7, 0))) div ({wide(x)} * {wide(y)})")


def _distinct_texts(docs: DataFrame, label: str) -> DataFrame:
    """t1, t2, lang, copies, text of every different text of a language, in buckets."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), text_of(docs).alias("text"))
    keyed = rows.select(*text_key(F.concat("lang", F.lit("\0"), "text")), "lang", "text")
    once = keyed.groupBy(*KEY).agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return bucketed(once, KEY, label, order=KEY)  # in order, so that sorting their occurrences finds them in order


def _word_counts(texts: DataFrame, label: str) -> tuple[int, DataFrame]:
    """A seed under which no two words share a key, and w, lang, word, n of each word."""
    for seed in range(1, 64):
        found = texts.select("lang", "copies", "text").mapInArrow(_lexicon(seed), "w long, lang string, word string, n long")
        lexicon = stored(found.groupBy("w", "lang", "word").agg(F.sum("n").alias("n")), f"{label}-lexicon")
        if lexicon.groupBy("w").count().where("count > 1").isEmpty():
            return seed, lexicon
        dropped(lexicon)
    raise ValueError("words share keys under every seed")


def mined(docs: DataFrame, least: int, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of words (w, lang, word, n), of pairs (w1, w2, a) and of triples (w1, w2, w3, a); pairs and triples of ``least`` or more."""
    texts = _distinct_texts(docs, f"{label}-texts")
    seed, lexicon = _word_counts(texts, label)
    frequent = docs.sparkSession.sparkContext.broadcast(_filter(lexicon.where(F.col("n") >= least), F.col("w")))
    with settings(docs.sparkSession, _MERGE):
        r1 = _sorted_relation(texts.mapInArrow(_occurrences(seed, frequent), "t1 long, t2 long, copies long, at int, w long"), f"{label}-r1")
        dropped(texts)
        met = _adjacent(r1.withColumnRenamed("w", "w1"), r1.select(*KEY, "at", F.col("w").alias("w2")))
        pairs = stored(met.groupBy("w1", "w2").agg(F.sum("copies").alias("a")).where(F.col("a") >= least), f"{label}-pairs")
        r2 = _sorted_relation(_let_through(met, _filter(pairs, F.xxhash64("w1", "w2"))), f"{label}-r2")
        dropped(r1)
        met = _adjacent(r2, r2.select(*KEY, "at", F.col("w2").alias("w3"))).groupBy("w1", "w2", "w3").agg(F.sum("copies").alias("a"))
        triples = stored(met.where(F.col("a") >= least), f"{label}-triples")
        dropped(r2)
    return lexicon, pairs, triples


def _scored(lexicon: DataFrame, pairs: DataFrame, triples: DataFrame, cover_percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    words = lexicon.select("w", "lang", "word", "n")
    first = words.select(F.col("w").alias("w1"), "lang", F.col("word").alias("word1"), F.col("n").alias("n1"))
    second = words.select(F.col("w").alias("w2"), F.col("word").alias("word2"), F.col("n").alias("n2"))
    twos = pairs.join(first, "w1").join(second, "w2")
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    uncovered = F.isnull("longer") | (F.col("longer") * 100 < F.col("a") * cover_percent)
    out2 = twos.join(longest, ["w1", "w2"], "left").where(uncovered).select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), _score("a", "n1", "n2").alias("score")
    )
    head = twos.select("w1", "w2", "lang", "word1", "word2", "n1", F.col("a").alias("a12"))
    tail = twos.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("n2").alias("n3"), F.col("a").alias("a23"))
    cuts = triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"])
    cuts = cuts.withColumn("s1", _score("a", "n1", "a23")).withColumn("s2", _score("a", "a12", "n3"))
    best = F.least(F.struct("s1", F.lit(1).alias("k"), F.col("n1").alias("l"), F.col("a23").alias("r")), F.struct(F.col("s2").alias("s1"), F.lit(2).alias("k"), F.col("a12").alias("l"), F.col("n3").alias("r")))
    out3 = cuts.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", best.alias("cut"))
    return out2.unionByName(out3.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.s1").alias("score")))


def _place(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))


def _ahead(rows: DataFrame, top: int) -> DataFrame:
    """Rows that are among the first ``top`` of a piece of their language, the first ``top`` of the language among them."""
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(PIECES)))
    return dealt.withColumn("place", _place("lang", "piece")).where(F.col("place") <= top).drop("piece", "place")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover_percent: int = COVER_PERCENT, label: str = "collocations") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language; columns text and lang of ``docs`` are read."""
    lexicon, pairs, triples = mined(docs, least, label)
    scored = _scored(lexicon.where(F.col("n") >= least), pairs, triples, cover_percent)
    ranked = _ahead(scored, top).withColumn("rank", _place("lang")).where(F.col("rank") <= top)
    totals = lexicon.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("text", "lang"))
