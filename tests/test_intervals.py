import random

import pytest

from lexispan.operators import intervals as I


def rows(spark, *spans, key="a"):
    return spark.createDataFrame([(key, float(s), float(e)) for s, e in spans], "k string, start double, end double")


@pytest.mark.parametrize(
    "spans, merged",
    [
        ([(0, 1), (2, 3)], [(0, 1), (2, 3)]),
        ([(0, 1), (1, 2)], [(0, 2)]),
        ([(0, 5), (1, 2), (4, 6)], [(0, 6)]),
        ([(3, 3), (5, 4)], []),
    ],
)
def test_islands(spark, spans, merged):
    found = I.islands(rows(spark, *spans), ["k"]).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == merged


def test_sliding_windows_end_with_their_interval(spark):
    found = I.sliding_windows(rows(spark, (0, 10)), 4.0, 3.0).orderBy("w").collect()
    assert [(r["w_start"], r["w_end"]) for r in found] == [(0, 4), (3, 7), (6, 10)]
    assert [(r["w_start"], r["w_end"]) for r in I.sliding_windows(rows(spark, (2, 3)), 4.0, 3.0).collect()] == [(2, 3)]


def test_capped_merge(spark):
    found = I.capped_merge(rows(spark, (0, 4), (4.5, 8), (8.2, 9), (20, 45)), "k", 1.0, 10.0).orderBy("start").collect()
    assert [(round(r["start"], 2), round(r["end"], 2)) for r in found] == [(0, 9), (20, 28.33), (28.33, 36.67), (36.67, 45)]


def test_overlap_join_equals_all_pairs(spark):
    draw = random.Random(3)
    spans = [(s := draw.uniform(0, 100), s + draw.uniform(0.1, 30)) for _ in range(60)]
    left, right = rows(spark, *spans[:30]), rows(spark, *spans[30:])
    found = {(r[0], r[1]) for r in I.overlap_join(left, right, "k", 7.0).select("l.start", "r.start").collect()}
    assert found == {(a[0], b[0]) for a in spans[:30] for b in spans[30:] if a[0] < b[1] and b[0] < a[1]}
    assert I.overlap_join(left, right, "k", 7.0).count() == len(found)


def test_label_runs_split_overlaps_and_keep_gaps(spark):
    rows = [("a", 0.0, 2.0, "x", 0.2), ("a", 1.0, 3.0, "x", 0.4), ("a", 4.0, 6.0, "y", 0.9), ("a", 5.0, 7.0, "x", 0.1)]
    df = spark.createDataFrame(rows, "k string, start double, end double, label string, p double")
    found = I.label_runs(df, ["k"], "label", "p").orderBy("run").collect()
    # 3.0 to 4.0 is a gap and stays one; 4-6 and 5-7 overlap and are split at 5.5
    assert [(r["label"], r["start"], r["end"], round(r["mean"], 6)) for r in found] == [("x", 0.0, 3.0, 0.3), ("y", 4.0, 5.5, 0.9), ("x", 5.5, 7.0, 0.1)]


def test_viterbi_ignores_noise_and_follows_change(spark):
    noise = [0.9, 0.9, 0.4, 0.9, 0.9]
    change = [0.9, 0.9, 0.1, 0.1, 0.1]
    df = spark.createDataFrame([("n", i, p) for i, p in enumerate(noise)] + [("c", i, p) for i, p in enumerate(change)], "k string, ord int, p double")
    states = {k: [] for k in "nc"}
    for r in I.viterbi(df, "k", "p", 2.0).orderBy("k", "ord").collect():
        states[r["k"]].append(r["state"])
    assert states == {"n": [1] * 5, "c": [1, 1, 0, 0, 0]}


def test_target_runs_break_at_others(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 1.0, True), ("a", 1.5, 2.0, True), ("a", 2.1, 2.2, False), ("a", 2.3, 3.0, True), ("a", 9.0, 9.5, True)],
        "k string, start double, end double, target boolean",
    )
    found = I.target_runs(df, ["k"], "target", 1.0).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n"]) for r in found] == [(0.0, 2.0, 2), (2.3, 3.0, 1), (9.0, 9.5, 1)]


def test_runs_of_repeated_events_equal_their_sql(spark, tmp_path):
    """Events that are there several times: the first of equal windows has the neighbour that a run's start is split with, and counts at its end, too."""
    import datetime

    import duckdb

    from lexispan.plans import registry

    at = datetime.datetime(2024, 1, 1)
    once = [(u, k, kind, at + datetime.timedelta(seconds=40 * k), 50.0 + k) for u in (1, 2) for k, kind in enumerate(["view", "click", "error", "error", "view", "purchase"])]
    rows = [(i, ts, u, kind, value) for i, (u, _, kind, ts, value) in enumerate(3 * once)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {(r[0], int(r[1])): r[2:] for r in duck.execute(registry.ORACLE_SQL["window_runs_midpoint"]).fetchall()}
    got = {(r["user_id"], r["run"]): tuple(r)[2:] for r in registry.QUERIES["window_runs_midpoint"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 8
