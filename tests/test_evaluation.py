"""Resampled intervals, scores of spans and the sample with quotas, against plain loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lexispan.operators import resampling as RS
from lexispan.operators import sampling as SA
from lexispan.operators import span_scores as SS


def quantile(values, fraction):
    values = sorted(values)
    at = fraction * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def resampled(clusters, rounds, seed, statistic):
    """clusters: name -> values. The same draws, each cluster's values repeated."""
    order = sorted(clusters, key=lambda c: hashlib.sha256(c.encode()).hexdigest())
    if len(order) < 2:
        return None
    estimates = []
    for r in range(rounds):
        drawn = [order[int(hashlib.sha256(f"{seed}:{r}:{i}".encode()).hexdigest()[:8], 16) % len(order)] for i in range(1, len(order) + 1)]
        estimates.append(statistic([abs(v) for c in drawn for v in clusters[c]]))
    return tuple(round(quantile(estimates, q), 4) for q in (0.025, 0.975))


@pytest.mark.parametrize("ranges", [64, 3])
def test_intervals_equal_a_plain_loop(spark, monkeypatch, ranges):
    monkeypatch.setattr(RS, "RANGES", ranges)
    draw = random.Random(1)
    cells = {
        "many": {f"v{k}": [draw.gauss(0, 0.2 + k / 20) for _ in range(draw.randint(1, 40))] for k in range(25)},
        "ties": {f"v{k}": [draw.choice([0.1, 0.2, 0.2, -0.2, 0.3]) for _ in range(draw.randint(1, 9))] for k in range(7)},
        "apart": {"a": [0.01] * 20, "b": [0.01] * 20, "c": [0.01] * 20, "d": [0.5] * 20},
        "one": {"a": [0.1, 0.2]},
    }
    rows = [(c, v, x) for c, vs in cells.items() for v, xs in vs.items() for x in xs] + [("many", None, 9.0), ("many", "v1", None)]
    df = spark.createDataFrame(rows, "cell string, video string, delta double").repartition(3)
    found = {r["cell"]: r for r in RS.error_intervals(df, ["cell"], "video", "delta", 0.2, 60, "s").collect()}
    for cell, clusters in cells.items():
        median = resampled(clusters, 60, "s", lambda v: quantile(v, 0.5))
        within = resampled(clusters, 60, "s", lambda v: sum(x <= 0.2 for x in v) / len(v))
        r = found[cell]
        assert r["clusters"] == len(clusters)
        if median is None:
            assert r["median_abs_low"] is r["median_abs_high"] is r["within_low"] is None
        else:
            assert (r["median_abs_low"], r["median_abs_high"]) == pytest.approx(median, abs=1.1e-4)
            assert (r["within_low"], r["within_high"]) == pytest.approx(within, abs=1.1e-4)
    assert found["apart"]["median_abs_high"] - found["apart"]["median_abs_low"] > 0.1


def test_clusters_of_several_parts_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(RS, "SPAN", 4)
    monkeypatch.setattr(RS, "RANGES", 5)
    draw = random.Random(3)
    cells = {c: {f"v{k}": [draw.gauss(0, 1) for _ in range(draw.randint(1, 6))] for k in range(n)} for c, n in (("a", 19), ("b", 4), ("c", 5))}
    df = spark.createDataFrame([(c, v, x) for c, vs in cells.items() for v, xs in vs.items() for x in xs], "cell string, video string, delta double").repartition(3)
    found = {r["cell"]: r for r in RS.error_intervals(df, ["cell"], "video", "delta", 0.5, 30, "s").collect()}
    for cell, clusters in cells.items():
        r = found[cell]
        assert (r["median_abs_low"], r["median_abs_high"]) == pytest.approx(resampled(clusters, 30, "s", lambda v: quantile(v, 0.5)), abs=1.1e-4)
        assert (r["within_low"], r["within_high"]) == pytest.approx(resampled(clusters, 30, "s", lambda v: sum(x <= 0.5 for x in v) / len(v)), abs=1.1e-4)


def test_registered_intervals_take_a_thousand_rounds(spark, monkeypatch):
    from lexispan.plans import evaluation_queries as E

    taken = []
    monkeypatch.setattr(RS, "error_intervals", lambda *args: taken.append(args[5]))
    E.timing_error_intervals(spark, "/root/testdata/sf0.001")
    assert taken == [1000]


def plain_scores(spans, labels, strict):
    """Intervals of whole seconds as sets of seconds."""
    seconds = lambda rows: {t for s, e in rows for t in range(s, e)}
    kinds = {"target": "target", "other": "other", **({"mixed": "other", "unsure": "other"} if strict else {})}
    truth = sorted((s, e, kinds[k]) for s, e, k in labels if k in kinds and e > s)
    target, other = (seconds([(s, e) for s, e, k in truth if k == want]) for want in ("target", "other"))
    unclear, accepted = seconds([(s, e) for s, e, k in labels if k in ("mixed", "unsure")]), seconds(spans)
    out = dict.fromkeys((*SS.COUNTS, *SS.SECONDS, *SS.UNCLEAR_MEASURES), 0)
    out |= {"spans": len(spans), "target_seconds": len(target), "other_seconds": len(other), "accepted_target_seconds": len(target & accepted), "accepted_other_seconds": len(other & accepted)}
    for s, e in spans:
        own = set(range(s, e))
        on, off = len(own & target), len(own & other)
        if on + off:
            out["judged_spans"] += 1
            out["correct_spans"] += on / (on + off) >= 0.8
            out["hard_failures"] += on / (on + off) <= 0.5
        out["unjudgeable_seconds_in_spans"] += len(own & unclear)
        out["spans_touching_mixed_or_unsure"] += bool(own & unclear)
    runs = []
    for k, (s, e, kind) in enumerate(truth):
        if kind == "target" and k and truth[k - 1][2] == "target" and s - truth[k - 1][1] <= 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        elif kind == "target":
            runs.append((s, e))
    for s, e in runs:
        if e - s >= 5:
            heard = set(range(s, e)) & target
            out["long_runs"] += 1
            out["long_run_target_seconds"] += len(heard)
            out["long_run_accepted_seconds"] += len(heard & accepted)
            out["long_runs_half_covered"] += len(heard & accepted) >= 0.5 * len(heard)
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [600.0, 7.0])
def test_spans_against_truth(spark, strict, width):
    draw = random.Random(3)
    clips = {}
    for c in range(25):
        labels, at = [], 0
        for _ in range(draw.randint(0, 14)):
            at += draw.choice([0, 0, 1, 2, 5])
            labels.append((at, at := at + draw.randint(1, 9), draw.choice(["target", "target", "target", "other", "mixed", "unsure", "no_speech", None])))
        clips[f"c{c}"] = ([(s := draw.randint(0, 60), s + draw.randint(1, 25)) for _ in range(draw.randint(0, 5))], labels)
    spans = spark.createDataFrame([(c, f"{c}-{k}", float(s), float(e)) for c, (rows, _) in clips.items() for k, (s, e) in enumerate(rows)], "clip string, id string, start double, end double")
    labels = spark.createDataFrame([(c, float(s), float(e), k) for c, (_, rows) in clips.items() for s, e, k in rows], "clip string, start double, end double, kind string")
    scores = SS.score(spans, labels, "clip", "id", strict, width=width)
    found = {r["clip"]: r.asDict() for r in scores.collect()}
    for c, (rows, truth) in clips.items():
        if rows or truth:
            want = plain_scores(rows, truth, strict)
            assert {k: found[c][k] for k in want} == pytest.approx(want)
    whole = SS.rates(SS.pooled(scores, [])).first()
    total = lambda k: sum(r[k] for r in found.values())
    assert whole["span_precision"] == total("correct_spans") / total("judged_spans") and total("long_runs_half_covered") > 3
    assert whole["time_recall"] == pytest.approx(total("accepted_target_seconds") / total("target_seconds"))
    bands = SS.by_duration(spans, labels, "clip", "id", [5.0, 10.0], strict, width=width).orderBy("bucket").collect()
    assert sum(b["judged_spans"] for b in bands) == total("judged_spans") and sum(b["correct_spans"] for b in bands) == total("correct_spans")
    assert [(b["low"], b["high"]) for b in bands] == [(0, 5), (5, 10), (10, math.inf)]


def test_no_spans_have_no_precision(spark):
    labels = spark.createDataFrame([("c", 0.0, 6.0, "target"), ("c", 7.0, 8.0, "mixed")], "clip string, start double, end double, kind string")
    spans = spark.createDataFrame([], "clip string, id string, start double, end double")
    row = SS.rates(SS.score(spans, labels, "clip", "id")).first()
    assert (row["span_precision"], row["time_precision"], row["long_run_recall"], row["time_recall"]) == (None, None, 0.0, 0.0)
    alone = spark.createDataFrame([("c", "s", 7.0, 8.0)], spans.schema)
    assert SS.score(alone, labels, "clip", "id").first()["judged_spans"] == 0
    assert SS.score(alone, labels, "clip", "id", strict=True).first()["hard_failures"] == 1


def greedy(rows, requested, cap, gap, seed):
    fate, videos, strata, spans = {}, {}, {}, {}
    for ident, stratum, video, s, e in sorted(rows, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()):
        if strata.get(stratum, 0) >= requested[stratum]:
            fate[ident] = "quota"
        elif videos.get(video, 0) >= cap:
            fate[ident] = "video_cap"
        elif any(s < b + gap and a - gap < e for a, b in spans.get(video, [])):
            fate[ident] = "neighbour"
        else:
            fate[ident] = "taken"
            strata[stratum] = strata.get(stratum, 0) + 1
            videos[video] = videos.get(video, 0) + 1
            spans.setdefault(video, []).append((s, e))
    return fate


@pytest.mark.parametrize(("seed", "cap", "quotas"), [("a", 4, (10, 9, 60)), ("b", 100, (5, 1, 1)), ("c", 2, (40, 40, 40))])
def test_sample_with_quotas_equals_one_pass(spark, seed, cap, quotas):
    draw = random.Random(seed)
    requested = dict(zip("xyz", quotas))
    rows = []
    for k in range(240):
        start = draw.uniform(0, 300)
        rows.append((k, draw.choice("xxyz"), draw.choice(["hot", "hot", *(f"v{i}" for i in range(9))]), start, start + draw.uniform(1, 15)))
    df = spark.createDataFrame(rows, "id int, stratum string, video string, start double, end double").repartition(3)
    fates = SA.quota_sample(df, list(requested.items()), "stratum", "video", "id", seed, cap, 3.0, 20.0)
    assert {r["id"]: r["fate"] for r in fates.collect()} == greedy(rows, requested, cap, 3.0, seed)
    report = {r["stratum"]: r for r in SA.sample_report(fates, [*requested.items(), ("none", 3)], "stratum", "video").collect()}
    assert (report["none"]["selected"], report["none"]["missing"], report["none"]["eligible"]) == (0, 3, 0)
    assert sum(r["eligible"] for r in report.values()) == 240 and all(r["missing"] == max(0, r["requested"] - r["selected"]) for r in report.values())
    assert fates.where(F.col("fate").isNull()).count() == 0
