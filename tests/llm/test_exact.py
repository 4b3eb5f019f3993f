"""Operators with exact results against plain versions, over odd and planted texts."""

import base64
import hashlib
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lexispan.llm import byte_pairs, byte_repeats, near_copies, quality_rules, sharding, simhash, spans, substring_dedup, token_counts


def keyed(df, *names):
    return Counter(tuple(r[n] for n in ("doc_id", *names)) for r in df.collect())


def ids_of(docs):
    rows = docs.orderBy("node").select("doc_id", "text").collect()
    return [r["doc_id"] for r in rows], [r["text"] for r in rows]


def registered(spark, docs, query, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return query(spark, str(tmp_path))


def test_byte_repeats(spark, docs, tmp_path):
    ids, texts = ids_of(docs)
    found = registered(spark, docs, byte_repeats.op1_suffix_dedup, tmp_path)
    want = Counter((i, *r) for i, r in zip(ids, brute.removed_bytes(texts)))
    assert keyed(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(r[2] > 0 for r in want) > 5


def test_word_repeats(spark, docs, tmp_path):
    ids, texts = ids_of(docs)
    found = registered(spark, docs, substring_dedup.op10_substring_dedup, tmp_path)
    want = Counter((i, *r) for i, r in zip(ids, brute.removed_words(texts)))
    assert keyed(found, "n_words", "n_removed", "kept_sha256") == want


def test_pieces_of_long_texts_give_the_same(spark, docs, monkeypatch):
    ids, texts = ids_of(docs)
    layout = byte_repeats.BYTES
    for text in texts:
        whole = [x for u in spans.units_of(text, layout) for x in zip(u[0].tolist(), u[1].tolist())]
        monkeypatch.setattr(spans, "PIECE", 97)
        cut = [x for u in spans.units_of(text, layout) for x in zip(u[0].tolist(), u[1].tolist())]
        monkeypatch.undo()
        cover = lambda pairs: sorted(k for lo, hi in pairs for k in range(lo, hi + 1))
        assert cover(whole) == cover(cut) == list(range(max(0, len((text or "").encode()) - 399)))


def test_repeats_removed_keep_columns(docs):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_byte_pairs(spark, docs, tmp_path):
    import tiktoken

    ids, texts = ids_of(docs)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_pairs.VOCABULARY), "rb"))}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in zip(ids, texts):
        tokens = known.encode_ordinary(t or "")
        want[(i, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    found = registered(spark, docs, byte_pairs.op2_byte_pairs, tmp_path)
    assert keyed(found, "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_byte_pairs_round_trip(docs):
    back = byte_pairs.decode(byte_pairs.encode(docs))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("piece", ["aaaaaaaaa", "abababab" * 50, "the" * 33, "zzz🙂zzz", "qqqqq" * 201])
def test_merges_of_long_pieces(piece):
    import tiktoken

    own = byte_pairs.coder(P.path(byte_pairs.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own.ranks, special_tokens={})
    assert byte_pairs.merge(piece.encode(), own.ranks) == known.encode_ordinary(piece)


def test_merges_of_random_pieces():
    import random

    import tiktoken

    own = byte_pairs.coder(P.path(byte_pairs.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own.ranks, special_tokens={})
    draw = random.Random(8)
    for alphabet in ("ab", "etaoinshrdlu ", "éàxyz🙂", "0123456789-"):
        for n in (1, 2, 3, 10, 40, 120, 500):
            piece = "".join(draw.choice(alphabet) for _ in range(n))
            assert byte_pairs.merge(piece.encode(), own.ranks) == known.encode_ordinary(piece)


def test_token_counts(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    ids, texts = ids_of(docs)
    known = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    counts = [len(known.encode(t or "", add_special_tokens=False)) for t in texts]
    want = Counter((i, len((t or "").encode()), n, n > 2048) for i, t, n in zip(ids, texts, counts))
    found = registered(spark, docs, token_counts.op3_token_counts, tmp_path)
    assert keyed(found, "n_bytes", "n_tokens", "over_limit") == want
    own = token_counts._tokenizer(P.path(token_counts.VOCABULARY))
    for chunk, overlap in ((40, 8), (200, 16), (1000, 64)):
        assert [token_counts.count_in_chunks(own, t or "", chunk, overlap) for t in texts] == counts


def test_quality_rules(spark, docs, tmp_path):
    ids, texts = ids_of(docs)
    found = registered(spark, docs, quality_rules.op5_quality_rules, tmp_path)
    want = Counter((i, *brute.quality(t)) for i, t in zip(ids, texts))
    assert keyed(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert found.where("base_failed and kept").count() == 0


def test_quality_plan_has_one_kind_of_node(docs):
    plan = quality_rules.quality_measures(docs, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Python" not in plan
    assert quality_rules.quality_filter(docs).columns == docs.columns


def test_sharding(spark, docs, tmp_path):
    rows = registered(spark, docs, sharding.op8_sharding, tmp_path).collect()
    ids, texts = ids_of(docs)
    data = [(t or "").encode() for t in texts]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(b) + 16, zlib.crc32(b)) for i, b in zip(ids, data))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_sharding_equals_plain_ranking(docs):
    """Rows of each source in the order of their draw, then all by fractional rank, cut to equal runs."""
    draw = F.xxhash64(F.lit(sharding.SEED), F.col("doc_id").cast("long"))
    phase = F.pmod(F.xxhash64(F.lit(sharding.SEED), F.lit("phase"), F.col("source")), F.lit(1 << 20)) / (1 << 20)
    rows = docs.select("doc_id", "source", "text", draw.alias("draw"), phase.alias("phase")).collect()
    low = lambda x: (x is not None, x)  # noqa: E731  nulls first
    sized = [(r["source"], r["draw"], low(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16, r["phase"]) for r in rows]
    placed = []
    for source in {x[0] for x in sized}:
        own = sorted(x[1:] for x in sized if x[0] == source)
        placed += [((k + x[-1]) / len(own), low(source), x) for k, x in enumerate(own)]
    order = sorted(placed)
    want = Counter()
    starts = [-(-shard * len(order) // 8) for shard in range(9)]
    for k, (_, _, x) in enumerate(order):
        shard = k * 8 // len(order)
        want[(x[1][1], x[2], shard, k - starts[shard])] += 1
    got = Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleaved_shards(docs, 8).collect())
    assert got == want


def test_one_row_sources_spread(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("host"), F.col("id")).alias("source"))
    shards = sharding.interleaved_shards(rows, 8)
    assert shards.select("source").distinct().count() == 2000 and {r["count"] for r in shards.groupBy("shard").count().collect()} == {250}


def test_token_counts_of_text_without_blanks():
    import random
    import time

    own = token_counts._tokenizer(P.path(token_counts.VOCABULARY))
    draw = random.Random(6)
    text = "".join(chr(draw.choice([*range(0x3041, 0x3096), *range(0x4E00, 0x5200)])) for _ in range(1_000_000))
    began = time.perf_counter()
    whole = len(own.encode(text, add_special_tokens=False).ids)
    between = time.perf_counter()
    assert token_counts.count_in_chunks(own, text) == whole
    assert time.perf_counter() - between < 2 * (between - began) + 1
    odd = "".join(draw.choice(["a", "the", "e\u0301", "'s", "!!", "'", "1", "<|endoftext|>", "🙂", "Σ", "ß", "\u00a0"]) for _ in range(4_000))
    for chunk, overlap in ((40, 1), (100, 16), (1000, 64)):
        assert token_counts.count_in_chunks(own, odd, chunk, overlap) == len(own.encode(odd, add_special_tokens=False).ids)


def test_shards_match_the_mixture(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    shards = sharding.interleaved_shards(rows, 8)
    shares = shards.groupBy("shard", "source").count().groupBy("source").agg(F.max("count").alias("hi"), F.min("count").alias("lo"))
    assert all(r["hi"] - r["lo"] <= 2 for r in shares.collect())


def test_simhash(spark, docs, tmp_path):
    ids, texts = ids_of(docs)
    found = registered(spark, docs, simhash.op9_simhash_dedup, tmp_path).collect()
    prints = [brute.fingerprint(t) for t in texts]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in found) == Counter((i, f"{p:016x}") for i, p in zip(ids, prints))
    root = brute.components(prints)
    group = {}
    for k, r in enumerate(root):
        group.setdefault(r, []).append(ids[k])
    plain = [k for k in range(len(ids)) if ids[k] is not None and ids.count(ids[k]) == 1 and not {None, 3} & set(group[root[k]])]
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert len(plain) > 30 and all(got[ids[k]] == min(group[root[k]]) for k in plain)


def test_simhash_links_near_prints(spark):
    import random

    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = sorted({p ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for p in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, k) for k, p in enumerate(signed)], "fp long, node long")
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3}
    for crowd in (256, 1):
        simhash.CROWD, before = crowd, simhash.CROWD
        got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.near_links(table).collect()}
        simhash.CROWD = before
        assert got == want


def test_one_of_each_keeps_the_least(docs):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert 0 in kept and 25 not in kept and 26 not in kept


def test_one_of_each_takes_near_copies(spark):
    import random

    draw = random.Random(3)
    base = [[f"w{draw.randrange(3000)}" for _ in range(draw.randint(40, 300))] for _ in range(40)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(4):  # edits of a word each, up to about the threshold and beyond it
            other = list(words)
            for _ in range(draw.randint(1, max(1, len(words) // 30))):
                other[draw.randrange(len(other))] = f"new{draw.randrange(10**6)}"
            texts.append(" ".join(other))
    texts += ["", " ", "a b", "A  b", "a c"]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) or {tuple(t.lower().split())} for t in texts]
    link = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if link(sets[i], sets[j])]
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    differing = [(i, j) for i, j in pairs if sets[i] != sets[j]]
    assert len(differing) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in near_copies.one_of_each(docs).collect()} == set(root)


def test_null_and_shared_ids_stay_apart(spark, texts, tmp_path):
    own = [t for t in texts[:25] if len(t.split()) > 20]
    rows = [(None if k % 3 else 5, t) for k, t in enumerate(own)] + [(900, own[1]), (901, own[2])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = registered(spark, table, simhash.op9_simhash_dedup, tmp_path).collect()
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in found}
    prints = [f"{brute.fingerprint(t):016x}" for t in own]
    for k, p in enumerate(prints):
        ident = None if k % 3 else 5
        assert got[ident, p] == {1: 900, 2: 901}.get(k, ident)
    # 5 is shared by unrelated texts, 900 and 901 are copies of texts without an id
    kept = near_copies.one_of_each(table).collect()
    assert sorted(r["text"] for r in kept) == sorted(own)
    assert {r["text"]: r["doc_id"] for r in kept}[own[1]] == 900


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for query in (byte_repeats.op1_suffix_dedup, byte_pairs.op2_byte_pairs, token_counts.op3_token_counts, quality_rules.op5_quality_rules, sharding.op8_sharding, simhash.op9_simhash_dedup, substring_dedup.op10_substring_dedup):
        assert query(spark, str(tmp_path)).collect() == []
