"""Hard negatives, near vectors and collocations against plain versions, over odd and planted rows."""

import random
import re

import brute_search as brute
import numpy as np
import pytest

from lexispan.llm import collocations, hard_negatives, near_vectors

VECTORS = "vec_id long, embedding array<float>, label int, node long, copies int, members string"


def vectors(seed, n=300, dim=12):
    """Unit vectors, some lengths apart, copies, a crowd around one, and odd rows."""
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dim))
    x[n // 2 :] = x[0] + draw.standard_normal((n - n // 2, dim)) * draw.choice([0.05, 0.2, 0.4], (n - n // 2, 1))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[: n // 4] *= draw.choice([0.1, 1, 3, 50], (n // 4, 1))
    out = [(k, v.astype(np.float32).tolist(), int(draw.integers(0, 4)), k, 1, "m") for k, v in enumerate(x)]
    out += [(n, out[3][1], 1, 0, 1, None), (n + 1, out[3][1], 1, 0, 1, None), (3, out[3][1], out[3][2], 0, 1, None), (3, out[4][1], 2, 0, 1, None), (None, out[0][1], 1, 0, 1, None)]
    bad = [None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0] * (dim - 1), [1e30, -1e30] * (dim // 2), [1e-30] * dim]
    out += [(700 + k * 50, v, k % 4, 0, 1, None) for k, v in enumerate(bad)] + [(1500, out[5][1], None, 0, 1, None)]
    return out


@pytest.mark.parametrize(("shelf", "block"), [(2048, 256), (16, 3)])
def test_hard_negatives(spark, monkeypatch, shelf, block):
    monkeypatch.setattr(hard_negatives, "SHELF", shelf)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = [(v[0], v[1], v[2], *v[3:]) for v in vectors(1) if not (v[1] and 1e30 in v[1])]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3))
    want = brute.hard_negatives([(r[0], r[2], r[1]) for r in rows])
    assert sorted(map(tuple, found.collect())) == want
    assert len(want) > 20


def test_hard_negatives_of_few_rows(spark):
    mine = lambda rows: sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()))
    assert mine([]) == []
    assert mine([(1, 0, [1.0])]) == []
    few = [(0, 3, [1.0, 0.0]), (50, 4, [0.8, 0.6]), (51, 4, [1.0, 0.1]), (52, 3, [0.9, 0.1]), (53, 3, [0.6, 0.1])]
    assert mine(few) == brute.hard_negatives(few) != []
    assert mine([(50, 1, [1e18]), (51, 1, [1e18]), (52, 2, [1e18])]) == []  # scores held to 64 bits: none is below the positive's


def test_ranges_hold_all_that_reach_the_score():
    draw = np.random.default_rng(3)
    rows, anchors = draw.integers(-60, 60, (400, 6)), draw.integers(-60, 60, (40, 6))
    rows[:200] = anchors[0] + draw.integers(-9, 9, (200, 6))
    unit, length = hard_negatives._unit(rows)
    scores, (q, q_length) = anchors @ rows.T, hard_negatives._unit(anchors)
    pruned = 0
    for quantile in (0.5, 0.95, 1):
        least = np.quantile(scores, quantile, axis=1)
        places = hard_negatives.feasible(q, q_length, least, length.max(), unit, np.argsort(unit, axis=0).T)
        for k, place in enumerate(places):
            pruned += place is not None
            assert place is None or set(np.flatnonzero(scores[k] >= least[k])) <= set(place.tolist())
    assert pruned > 10


def test_near_vectors(spark):
    rows = vectors(2)
    found = near_vectors.linked(spark.createDataFrame(rows, VECTORS).repartition(3))
    want = brute.near_vectors([(r[0], r[1]) for r in rows])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 20 for r in want) > 50
    assert near_vectors.linked(spark.createDataFrame([], VECTORS)).collect() == []


def test_tables_are_calibrated():
    """Pairs at the threshold collide NEED times in the tables that are chosen, whatever the pages."""
    draw = np.random.default_rng(5)
    x, z = (v / np.sqrt((v * v).sum(1))[:, None] for v in draw.standard_normal((2, 1500, 16)))
    z -= (x * z).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.sqrt((z * z).sum(1))[:, None]
    for bits in (3, 9):
        tables = near_vectors.tables_for(bits)
        along = near_vectors.directions(16, tables, bits, 9)
        a, b = ((v @ along).reshape(1500, tables, bits + 1) for v in (x, y))
        met = ((a[:, :, :bits] > 0) == (b[:, :, :bits] > 0)).all(2) & (np.abs(a[:, :, bits] - b[:, :, bits]) <= near_vectors.WINDOW * np.sqrt(0.2))
        assert (met.sum(1) >= near_vectors.NEED).mean() > 0.99


def phrases():
    draw = random.Random(6)
    words = [f"w{k}" for k in range(40)] + ["Été", "日本", "don't", "a b"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \x0b"]) for _ in range(draw.randint(0, 60)))
    rows = [(text() + " New York City hall" * draw.randint(0, 2), draw.choice(["en", "de", "und", None])) for _ in range(250)]
    return rows + rows[:30] + [rows[0]] * 20 + [(None, "en"), ("", None), (" \n\t", "fr"), ("x " * 4000, "xx"), ("one two", "yy")]


def test_collocations(spark):
    rows = phrases()
    docs = spark.createDataFrame([(t, lang, "k", 1, 2) for t, lang in rows], "text string, lang string, w string, at int, n int").repartition(3)
    for top in (2000, 7):
        assert sorted(map(tuple, collocations.collocations(docs, top=top).collect())) == brute.collocations(rows, top=top)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_words_that_share_keys_get_another_seed(spark, monkeypatch):
    rows, plain = phrases(), collocations.word_key
    monkeypatch.setattr(collocations, "word_key", lambda lang, word, seed: plain(lang, word, seed) % (50 if seed == 1 else 2**62))
    docs = spark.createDataFrame(rows, "text string, lang string")
    seed, lexicon = collocations._word_counts(collocations._distinct_texts(docs, "t"), "t")
    assert seed >= 1 and lexicon.groupBy("w").count().where("count > 1").isEmpty()


def test_keys_of_words_tell_words_languages_and_places():
    draw = random.Random(8)
    parts = ["a", "A", "é", "日本", "x" * 7, "x" * 8, "x" * 9, "y" * 256, "y" * 257, "y" * 600, "\0", "a\0", " ", "  ", "\t", ".", ",!", "\n", "\x0b"]
    texts = ["", " ", ".", *("".join(draw.choice(parts) + draw.choice(["", " "]) for _ in range(draw.randint(0, 40))) for _ in range(200))]
    langs = [draw.choice(["en", "de"]) for _ in texts]
    text, at, keys = collocations.keyed_words([t.encode().translate(collocations._TABLE) for t in texts], langs, 3)
    told = {}
    for k, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        pieces = [p.encode().split() for p in re.split("[.,;:!?\n\x0b\x0c\r]", t.translate({c: c + 32 for c in range(65, 91)}))]
        mine = np.flatnonzero(text == k)
        words = [w for p in pieces for w in p]
        assert len(mine) == len(words)
        joined = [j > 0 for p in pieces for j in range(len(p))][1:]
        assert (np.diff(at[mine]) == 1).tolist() == joined and (np.diff(at[mine]) >= 1).all()
        for w, key in zip(words, keys[mine].tolist(), strict=True):
            assert told.setdefault((lang, w), key) == key
    assert len(set(told.values())) == len(told)


def test_work_of_collocations_leaves_out_rare_words_and_python(spark, monkeypatch):
    draw, stored, plans = random.Random(9), {}, []
    rows = [(" ".join(f"r{k}x{j}" if j % 3 else draw.choice("abc") for j in range(60)), "en") for k in range(60)]
    plain, passed = collocations._sorted_relation, collocations._let_through

    def counted(df, label):
        out = plain(df, label)
        stored[label.rsplit("-", 1)[1]] = out.count()
        return out

    def planned(*given):
        out = passed(*given)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(collocations, "_sorted_relation", counted)
    monkeypatch.setattr(collocations, "_let_through", planned)
    rows += [("a b c", "en")] * 12 + [("b a c " * k, "en") for k in range(9)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute.collocations(rows)
    # 2,400 of the 3,711 occurrences are of words found once
    assert stored["r1"] == 60 * 20 + 3 + 3 * 36
    assert len(plans) == 1 and "InArrow" not in plans[0] and plans[0].count("Exchange") == 1


def test_the_last_ranking_takes_the_first_of_each_piece(spark):
    draw = random.Random(10)
    rows = [(draw.choice(["en", "en", "de"]), f"p{k:04d}", draw.randint(10, 12), draw.randint(0, 50)) for k in range(4_000)]
    few = [tuple(r) for r in collocations._ahead(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 3).collect()]
    assert len(few) <= 2 * 3 * collocations.PIECES and set(few) <= set(rows)
    for lang in ("en", "de"):
        first = lambda found: sorted((r for r in found if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1]))[:3]  # noqa: B023, E731
        assert first(few) == first(rows)


def test_scores_of_large_counts_are_exact(spark):
    cases = [(10**14 + 7, 10**15 + 3, 3 * 10**14 + 1), (3, 3, 3), (10, 99, 101), (2**52 + 1, 2**53 - 1, 2**52 + 3)]
    found = spark.createDataFrame(cases, "a long, x long, y long").select("a", "x", "y", collocations._score("a", "x", "y").alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["x"] * r["y"]) for r in found)
