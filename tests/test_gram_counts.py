"""Packed counts of n-grams against plain ones."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexispan.operators import gram_counts as GC
from lexispan.plans import index_queries as Q


def plain(rows):
    """language, n, normalized -> count, videos, least surface; ``rows``: doc_id, lang, text."""
    counts, videos, surfaces = Counter(), defaultdict(set), {}
    for doc, lang, text in rows:
        for line in (text or "").split("\n"):
            words = line.split()
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    surface = " ".join(words[i : i + n])
                    key = lang, n, surface.lower()
                    counts[key] += 1
                    videos[key] |= {doc} - {None}
                    surfaces[key] = min(surface, surfaces.get(key, surface))
    return {k: (c, len(videos[k]), surfaces[k]) for k, c in counts.items()}


def summed(stats):
    out = defaultdict(lambda: [0, 0, 0, 0, "~"])
    for (lang, n, _), (count, videos, surface) in stats.items():
        o = out[lang, n]
        out[lang, n] = [o[0] + 1, o[1] + count, max(o[2], count), o[3] + videos, min(o[4], surface)]
    return {k: tuple(v) for k, v in out.items()}


def test_packed_counts_equal_plain_ones(spark, monkeypatch):
    draw = random.Random(4)
    line = lambda: " ".join(draw.choice(["ab", "Ab", "c", "de", "De", "é", "f", "ghij"]) for _ in range(draw.randint(0, 7)))
    rows = [(draw.choice([*range(25), None]), draw.choice(["en", "de", None]), "\n".join(line() for _ in range(draw.randint(0, 4)))) for _ in range(60)] + [(99, "en", None)]
    monkeypatch.setattr("lexispan.functions.text.normalize_token", F.lower)  # é stays
    lists = Q.lists_of(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    want = plain(rows)
    found = {(r["language"], r["n"], r["normalized"]): (r["total_count"], r["video_count"], r["surface"]) for r in GC.frequent(lists, 4).collect()}
    assert found == {k: v for k, v in want.items() if v[0] >= 4} and len(found) > 20
    spread = {(r["language"], r["n"], r["normalized"]): (r["total_count"], r["video_count"], r["surface"]) for r in GC.most_spread(lists, 15).collect()}
    bound = sorted(v[1] for v in want.values())[-15]
    assert spread == {k: v for k, v in want.items() if v[1] >= bound}
    sums = {(r["language"], r["n"]): tuple(r)[2:] for r in GC.summary(lists).collect()}
    least = {(r["language"], r["n"]): r["least_surface"] for r in GC.least_surfaces(lists).collect()}
    assert {k: (*v, least[k]) for k, v in sums.items()} == summed(want)


def test_taken_away_texts_leave_no_grams(spark):
    docs = spark.createDataFrame([(1, "en", "a b c"), (2, "en", "b c d")], "doc_id long, lang string, text string")
    lists = GC.listed(docs).withColumn("sign", F.lit(1))
    moved = lists.unionByName(lists.where("video_key = 2").withColumn("sign", F.lit(-1)))
    assert {r["n"]: tuple(r)[2:] for r in GC.summary(moved).collect()} == {1: (3, 3, 1, 3), 2: (2, 2, 1, 2), 3: (1, 1, 1, 1)}
