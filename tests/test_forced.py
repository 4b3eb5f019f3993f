"""Forced alignment against a plain trellis, plans of ids, and groups that cover the text."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.operators import forced as FA


def plain_score(log_probs, labels):
    """Best total over all paths, by trying every one."""
    best = -math.inf
    states = range(len(labels))
    for path in itertools.product(states, repeat=len(log_probs)):
        if path[0] > 1 or path[-1] < len(labels) - 2:
            continue
        steps = zip(path, path[1:])
        if all(b - a in (0, 1) or (b - a == 2 and b % 2 == 1 and labels[b] != labels[a]) for a, b in steps):
            best = max(best, sum(log_probs[t][labels[s]] for t, s in enumerate(path)))
    return best


@pytest.mark.parametrize(("frames", "ids"), [(4, [1]), (5, [1, 2]), (6, [1, 1]), (6, [2, 1, 2]), (5, [1, 2, 1]), (3, [1, 2, 3]), (4, [])])
def test_path_is_the_best_of_all(frames, ids):
    log_probs = np.log(np.random.default_rng(frames + len(ids)).dirichlet([1] * 4, frames))
    path, labels = FA.best_path(log_probs, np.array(ids, int), 0), [0, *itertools.chain(*((i, 0) for i in ids))]
    total = sum(log_probs[t, labels[s]] for t, s in enumerate(path))
    assert total == pytest.approx(plain_score(log_probs.tolist(), labels))


def test_blocks_give_the_same_path(monkeypatch):
    """A path that is worked out again block by block equals one whose directions were all kept."""
    draw = np.random.default_rng(1)
    for _ in range(30):
        frames, n = int(draw.integers(1, 90)), int(draw.integers(0, 14))
        log_probs, ids = np.log(draw.dirichlet([0.4] * 6, frames)), draw.integers(1, 6, n)
        path = FA.best_path(log_probs, ids, 0)
        with monkeypatch.context() as m:
            m.setattr(FA, "BLOCK_ROOT", 1.0)
            whole = FA.best_path(log_probs, ids, 0)
        assert (path is None) == (whole is None) and (path is None or path.tolist() == whole.tolist())


def test_ids_that_do_not_fit():
    log_probs = np.zeros((3, 4))
    assert FA.best_path(log_probs, np.array([1, 1, 2]), 0) is None  # equal neighbours need a blank between
    assert FA.best_path(log_probs, np.array([1, 2, 3]), 0).tolist() == [1, 3, 5]
    assert FA.best_path(np.zeros((0, 4)), np.array([], int), 0) is None


def test_column_of_alignments(spark):
    peaks = lambda ids: [[0.0 if k == i else -9.0 for k in range(4)] for i in ids]
    rows = [(1, peaks([0, 1, 1, 0, 2, 2, 2]), [1, 2]), (2, peaks([1]), [1, 2]), (3, None, [1]), (4, peaks([0]), None), (5, peaks([0, 0]), [])]
    df = spark.createDataFrame(rows, "k int, e array<array<double>>, ids array<int>")
    found = {r["k"]: r["s"] for r in df.select("k", FA.forced_alignment(0)("e", "ids").alias("s")).collect()}
    assert [(s["token"], s["start"], s["end"], s["score"]) for s in found[1]] == [(0, 1, 3, 1.0), (1, 4, 7, 1.0)]
    assert (found[2], found[3], found[4], found[5]) == (None, None, None, [])
    frames = df.where("k = 1").select("k", F.posexplode("e").alias("f", "p")).orderBy(F.desc("f"))
    assert FA.emissions_of(frames, ["k"], "f", "p").first()["emissions"] == rows[0][1]


def vocabulary():
    return F.create_map(*(F.lit(x) for pair in {"a": 1, "b": 2, "C": 3, "ñ": 4, "s": 5, "h": 6}.items() for x in pair))


def test_plans_of_ids(spark):
    df = spark.createDataFrame([(1, "Áb  ?! cñ"), (2, " ?"), (3, ""), (4, "b\nzb x")], "k int, t string")
    plans = {r["k"]: [tuple(i) for i in r["plan"]] for r in FA.token_plans(df, ["k"], F.col("t"), vocabulary(), delimiter=9).collect()}
    assert plans == {
        1: [(1, 0, 0, 1), (2, 0, 1, 2), (9, -1, -1, -1), (3, 1, 7, 8), (4, 1, 8, 9)],
        4: [(2, 0, 0, 1), (9, -1, -1, -1), (2, 1, 3, 4)],
    }
    bare = FA.token_plans(df, ["k"], F.col("t"), vocabulary()).where("k = 4").first()["plan"]
    assert [i["word"] for i in bare] == [0, 1]


def test_characters_that_become_several_keep_their_place(spark):
    table = F.create_map(F.lit("щ"), F.lit("sh"), F.lit("¿"), F.lit(""))
    df = spark.createDataFrame([(1, "¿aщb")], "k int, t string")
    row = df.select(FA.mapped_characters(F.col("t"), table).alias("m"), FA.mapped_characters(F.col("t")).alias("same")).first()
    assert [tuple(x) for x in row["m"]] == [("a", 1, 2), ("s", 2, 3), ("h", 2, 3), ("b", 3, 4)]
    assert "".join(x["char"] for x in row["same"]) == "¿aщb"


def test_groups_cover_the_text(spark):
    text = "¿Ab, zz ba?"
    frames = [0, 1, 1, 2, 0, 0, 2, 1, 1, 0]
    emissions = [[math.log(0.9 if k == i else 0.02) for k in range(7)] for i in frames]
    df = spark.createDataFrame([("x", text, emissions), ("y", text, emissions[:2]), ("z", "?!", emissions)], "k string, text string, e array<array<double>>")
    plans = FA.token_plans(df, ["k"], F.col("text"), vocabulary())
    aligned = df.join(plans, "k", "left").withColumn("spans", FA.forced_alignment(0)("e", F.transform("plan", lambda i: i["id"])))
    found = {r["k"]: r for r in FA.timed_groups(aligned, ["k"], "text", F.lit(10.0)).collect()}
    groups = [(g["text"], g["char_start"], g["start"], g["end"], g["status"]) for g in found["x"]["groups"]]
    assert groups == [
        ("¿", 0, None, None, "punctuation"), ("Ab", 1, 0.1, 0.4, "matched"), (", zz ", 3, None, None, "unmatched"), ("ba", 8, 0.6, 0.9, "matched"), ("?", 10, None, None, "punctuation"),
    ]
    assert found["x"]["coverage"] == pytest.approx(4 / 6) and found["x"]["status"] == "partial"
    for k in "xyz":
        assert "".join(g["text"] for g in found[k]["groups"]) == (text if k != "z" else "?!")
    assert found["y"]["status"] == found["z"]["status"] == "failed"
