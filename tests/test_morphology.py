"""Scores of analyses and of lemma retrieval against plain loops."""

import random
from collections import defaultdict

import pytest

from lexispan.functions import text as X
from lexispan.operators import morphology as MO

GOLD = "s int, start int, end int, ord int, form string, lemma string, upos string"


def made(seed):
    """Sentences with contracted tokens, wrong splits, missing and wrong lemmas."""
    draw = random.Random(seed)
    gold, own = [], []
    for s in range(40):
        at = 0
        for k in range(draw.randint(1, 9)):
            n, upos = draw.choice([1, 1, 1, 2, 3]), draw.choice(["NOUN", "VERB", "PUNCT", None])
            for w in range(n):
                form = draw.choice(["Casa", "casa", "va", "el", "É"])
                lemma = draw.choice(["casa", "ir", "él", "_"])
                gold.append((s, at, at + 3, 10 * k + w, form, lemma, upos))
            if draw.random() < 0.85:
                for w in range(draw.choice([n, n, n, max(1, n - 1), n + 1])):
                    own.append((s, at, at + 3, 10 * k + w, draw.choice(["casa", "va", "el", "é"]), draw.choice(["casa", "CASA", "ir", "el", "_", None])))
            elif draw.random() < 0.5:
                own.append((s, at, at + 2, 10 * k, "ca", "ca"))
            at += 4
    return gold, own


LEXICON = [("casa", "casa", "NOUN"), ("CASA", "casar", "VERB"), ("va", "ir", "VERB"), ("va", "ir", "VERB")]


def plain(gold, own):
    strict = lambda t: None if t in (None, "_") else t.casefold()
    known = defaultdict(set)
    for f, lemma, u in LEXICON:
        known[strict(f)].add((lemma, u))
    spans, found = defaultdict(list), defaultdict(list)
    for r in sorted(gold, key=lambda r: r[3]):
        if r[6] != "PUNCT":
            spans[r[:3]].append(r)
    for r in sorted(own, key=lambda r: r[3]):
        found[r[:3]].append(r)
    out = defaultdict(lambda: dict.fromkeys(MO.COUNTS, 0))
    for span, words in spans.items():
        for k, w in enumerate(words):
            c = known.get(strict(w[4]), set())
            got = found[span][k][5] if k < len(found.get(span, [])) else None
            met = k < len(found.get(span, []))
            told = met and strict(got) is not None
            right = told and strict(got) == strict(w[5])
            fold = told and X.normal_token(got) == (X.normal_token(w[5]) if w[5] != "_" else None)
            flags = (1, met, told, right, fold, not c, not c and told, not c and right, len(c) > 1, len(c) > 1 and told, len(c) > 1 and right, met and not told, told and not right, not met)
            for cell in (None, w[6] or "NULL"):
                for n, f in zip(MO.COUNTS, flags):
                    out[cell][n] += int(f)
    several = [s for s, w in spans.items() if len(w) > 1]
    forms = lambda rows: [strict(r[4]) for r in rows]
    miss = sum(abs(len(w) - len(found.get(s, []))) + max(0, len(w) - len(found.get(s, []))) for s, w in spans.items())
    return out, (len(spans), len([s for s in found if found[s]]), len([s for s in spans if found.get(s)]), len(several), sum(forms(spans[s]) == forms(found.get(s, [])) for s in several), miss)


def test_analyses_against_gold(spark):
    gold, own = made(1)
    counts, spans = plain(gold, own)
    g = spark.createDataFrame(gold, GOLD).repartition(3)
    p = spark.createDataFrame(own, "s int, start int, end int, ord int, form string, lemma string")
    lexicon = spark.createDataFrame(LEXICON, "form string, lemma string, upos string")
    found = MO.outcome_rates(MO.outcome_counts(MO.word_outcomes(g, p, lexicon, ["s"]))).collect()
    assert {r["upos"]: {c: r[c] for c in MO.COUNTS} for r in found} == dict(counts)
    whole = next(r for r in found if r["upos"] is None)
    assert whole["coverage"] == pytest.approx(whole["predicted"] / whole["gold"], abs=1e-6) and whole["unseen_gold"] > 5 < whole["ambiguous_gold"]
    b = MO.boundary_scores(g, p, ["s"]).first()
    assert tuple(b[c] for c in ("gold_boundaries", "predicted_boundaries", "correct_boundaries", "gold_mwt", "correct_mwt", "tokenization_mismatch")) == spans
    nothing = MO.boundary_scores(g, p.limit(0), ["s"]).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (None, 0.0, 0.0)


def test_retrieval_against_gold_lemmas(spark):
    draw = random.Random(2)
    words = {"casa": ["casa"], "casas": ["casa", "casar"], "va": ["ir"], "vas": ["ir", "va"], "él": ["él"]}
    streams, gold = [], []
    for s in range(60):
        for at in range(5):
            form = draw.choice(list(words))
            lemma = draw.choice(words[form])
            gold.append((lemma, s, at))
            streams.append(("exact", X.normal_token(form), s, at))
            if draw.random() < 0.8:
                streams.append(("lemma", X.normal_token(draw.choice(words[form])), s, at))
    lexicon = [(f, lemma) for f, ls in words.items() for lemma in ls if (f, lemma) != ("vas", "va")] + [("él", "_")]
    queries = [(1, "Casas", "casa", "ambiguous_form"), (2, "va", "ir", "inflected"), (3, "nada", "nada", "inflected"), (4, "el", "él", "ambiguous_form"), (5, "va casa", "ir", "inflected")]
    q = spark.createDataFrame(queries, "query_id int, surface string, intended_lemma string, selection_class string")
    keys = MO.query_keys(q, spark.createDataFrame(lexicon, "form string, lemma string"), spark.createDataFrame([(2, "ir"), (4, "el")], "query_id int, key string"))
    got = {(r["query_id"], r["route"], r["key"]) for r in keys.collect()}
    assert got == {(1, "exact", "casas"), (1, "lemma", "casa"), (1, "lemma", "casar"), (2, "exact", "va"), (2, "lemma", "ir"), (3, "exact", "nada"), (4, "exact", "el"), (4, "lemma", "el"), (5, "exact", "va casa")}
    found = MO.retrieval_scores(q, keys, spark.createDataFrame(streams, "route string, key string, s int, at int"), spark.createDataFrame(gold, "lemma string, s int, at int"), ["s", "at"])
    for r in found.collect():
        hit = lambda route: {x[2:] for x in streams if (r["query_id"], x[0], x[1]) in got and x[0] == route}  # noqa: B023, E731
        exact, lemma, want = hit("exact"), hit("lemma"), {g[1:] for g in gold if g[0] == r["intended_lemma"]}
        assert (r["exact_count"], r["lemma_count"], r["auto_count"], r["deduplicated_expansion"]) == (len(exact), len(lemma), len(exact | lemma), len(lemma - exact))
        assert r["candidate_lemma_recall"] == (round(len(lemma & want) / len(want), 6) if want else None)
        assert r["intended_lemma_precision"] == (round(len(lemma & want) / len(lemma), 6) if lemma else None)
        both = exact | lemma
        assert r["ambiguous_union_precision"] == (round(len(both & want) / len(both), 6) if both and r["selection_class"] == "ambiguous_form" else None)
