"""Reports and checks on small cases that the given tables don't hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexispan.operators import reports as R


def test_last_duplicate_wins_and_absent_texts_are_left_out(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "row int, text string, start double")
    right = spark.createDataFrame([(1, "a", 0.5, 0), (1, "a", 1.5, 1), (3, "a", 9.0, 0)], "row int, text string, start double, ord int")
    assert R.engine_agreement(left, right, ["row", "text"]).collect() == [(2, 0.5, 0.5, 0.0, 0.0)]
    assert R.engine_agreement(left, right.where("false"), ["row", "text"]).first()["pairs"] == 0


def test_summary_counts_failures_once_and_drops_cells_without_deltas(spark):
    schema = "language string, video string, status string, coverage double, seconds double, clip_start double, clip_end double, deltas array<double>"
    rows = [
        ("en", "v", "complete", 0.5, 1.0, 0.0, 2.0, [0.1, -0.3]),
        ("en", "v", "failed", 0.9, 1.0, 0.0, 2.0, [9.0, 9.0]),
        ("en", "w", "partial", 1.0, 1.0, 3.0, 2.0, []),
        ("en", "x", None, 1.0, 5.0, 0.0, 2.0, [5.0]),
        ("de", "y", "unavailable", None, 1.0, 0.0, 2.0, None),
    ]
    [got] = R.system_summary(spark.createDataFrame(rows, schema), ["language"], [0.2]).collect()
    assert got.asDict() == dict(
        language="en", segments=1, videos=1, words=2, median_abs=0.2, p90_abs=0.28, median_signed=-0.1, within_200ms=0.5,
        coverage=0.5, failures=2, seconds_per_audio_second=0.75, indicative_only=True,
    )


def test_a_run_without_whole_windows_takes_those_that_overlap(spark):
    runs = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 20.0, 21.0)], "key int, run int, start double, end double")
    windows = spark.createDataFrame([(1, 0.0, 5.0, 0.2), (1, 5.0, 10.0, 0.4), (1, 9.0, 20.5, 0.9), (1, 20.5, 30.0, 0.5)], "key int, start double, end double, p double")
    got = R.run_means(runs, windows, "key", ["run"], "p", 7.0).orderBy("run").collect()
    assert [(r.run, r.n_windows, round(r["mean"], 6)) for r in got] == [(0, 2, 0.3), (1, 2, 0.7)]


def test_unclear_units_and_empty_tables(spark):
    units = spark.createDataFrame([(1, i, s, e) for i, s, e in ((0, 0.0, 1.0), (1, 2.0, 4.0), (2, 8.0, 9.0))], "key int, id int, start double, end double")
    spans = spark.createDataFrame([(1, 0.0, 0.98), (1, 3.0, 5.0), (1, 3.5, 6.0)], "key int, start double, end double")
    got = R.mixed_unit_report(R.covered(units, spans, "key", "id", 3.0)).first()
    assert (got.units, got.fully_inside_a_span, got.partially_cut, got.untouched, round(got.covered_seconds, 6)) == (3, 1, 1, 1, 1.98)
    none = R.mixed_unit_report(R.covered(units.where("false"), spans, "key", "id", 3.0)).first()
    assert (none.units, none.seconds, none.covered_fraction) == (0, 0.0, None)


def test_units_at_both_ends_of_a_clip_count(spark):
    units = spark.createDataFrame([(1, 2.0, "a"), (1, 9.0, "b"), (1, 9.1, "c"), (1, 5.0, "  "), (1, 5.0, None)], "key int, start double, text string")
    clips = spark.createDataFrame([(1, 7, 2.0, 9.0)], "key int, clip_id int, clip_start double, clip_end double")
    assert sorted(map(tuple, R.reference_starts(units, clips, "key", 4.0).collect())) == [(7, "a", 0.0), (7, "b", 7.0)]


def test_conditions_of_a_cache_listing(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = spark.createDataFrame([("k1", "es", "p", "m", day(1)), ("k2", "es", "q", "m", day(5)), ("k3", "de", "p", "m", day(9))], "cache_key string, target_language string, provider string, model string, last_accessed_at timestamp")
    keys = lambda **c: [(r.stage, r.cache_key) for r in R.cache_listing({"a": rows, "b": rows}, ["cache_key"], 3, **c).collect()]
    assert keys() == [("a", "k3"), ("b", "k3"), ("a", "k2")]
    assert keys(target_language="es", provider="p", model="m") == [("a", "k1"), ("b", "k1")]
    assert keys(older_than_days=4, now=F.lit("2024-01-09").cast("timestamp")) == [("a", "k1"), ("b", "k1")]
    with pytest.raises(ValueError):
        keys(older_than_days=-1)


def test_columns_of_checks(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    cjk = lambda t, a, n: value(R.unreliable_cjk(F.lit(t), F.lit(a), F.lit(n)))
    assert [cjk("日本語の文", "unicode", 1), cjk("かな", "unicode", 0), cjk("日本語", "mecab", 1), cjk("日本 語", "unicode", 2), cjk("word", "unicode", 1), cjk(None, "unicode", 1)] == [True, True, False, False, False, False]
    feature = value(R.agreement_feature(F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    assert (feature.status, feature.error, feature.error_rate, feature.agreement) == ("unavailable", "empty_reference", None, None)
    usage = value(R.merged_usage(F.expr("map('a', 1L, 'b', null)"), F.expr("cast(null as map<string,bigint>)")))
    assert usage == {"a": 1, "b": 0}


def test_manifests_with_nulls_are_equal_and_absent_ones_are_not(spark):
    expected = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, v string")
    there = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    assert [r.valid for r in R.valid_clips(expected, there, "k", ["v"]).orderBy("k").collect()] == [True, False, False]


def test_decisions_may_set_null(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, verdict string")
    decisions = spark.createDataFrame([(1, 0, "z"), (1, 1, None)], "k int, at int, verdict string")
    got = R.with_decisions(rows, decisions, "k", ["at"], ["verdict"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, None, True), (2, "y", False)]


def test_quantiles_by_ranges_are_exact(spark, monkeypatch):
    import random

    draw = random.Random(5)
    for around, values in ((0.001, [draw.gauss(0, 1) for _ in range(3000)]), (0.0005, [draw.choice([1.0, 2.0, 2.5]) for _ in range(500)]), (0.01, [3.0]), (0.01, [1.0, 2.0])):
        monkeypatch.setattr(R, "AROUND", around)
        rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        for share in (0.5, 0.9, 0.0, 1.0):
            want = rows.agg(F.percentile("x", F.lit(share))).first()[0]
            assert R.exact_quantile(rows, F.col("x"), len(values), share) == pytest.approx(want, abs=1e-12)
