"""Accepted spans against the truth of who speaks: time, spans and long runs, strictly and leniently.

Time is measured by a sweep over the starts and ends of all intervals of a clip, cut into stretches of ``width`` seconds first, so that a
clip of any length is many small groups. Only speech counts: silence under a span is neither right nor wrong. Truth has the kinds target, other, and
those that can't be judged (mixed, unsure), which count as other in the strict reading and as nothing in the lenient one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions.measures import ratio
from lexispan.operators import intervals as I

UNCLEAR = ("mixed", "unsure")
COUNTS = ("spans", "judged_spans", "correct_spans", "hard_failures", "long_runs", "long_runs_half_covered")
SECONDS = ("target_seconds", "other_seconds", "accepted_target_seconds", "accepted_other_seconds", "long_run_target_seconds", "long_run_accepted_seconds")
UNCLEAR_MEASURES = ("unjudgeable_seconds_in_spans", "spans_touching_mixed_or_unsure")


def read_truth(labels: DataFrame, strict: bool) -> DataFrame:
    """Rows whose ``kind`` is target or other, or unclear where that isn't judged; others (null, silence) don't count."""
    unclear = F.col("kind").isin(*UNCLEAR)
    kind = F.when(F.col("kind").isin("target", "other"), F.col("kind")).when(unclear, F.lit("other" if strict else "unclear"))
    return labels.withColumn("kind", kind).where("kind is not null and end > start")


def stretches(rows: DataFrame, key: str, width: float) -> DataFrame:
    """Intervals cut at multiples of ``width``, with the number of the stretch as ``bucket``."""
    last = F.floor(F.when(F.col("end") % width == 0, F.col("end") - width / 2).otherwise(F.col("end")) / width)
    cut = rows.where("end > start").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.greatest(last, F.floor(F.col("start") / width)))))
    return cut.withColumn("start", F.greatest("start", F.col("bucket") * F.lit(float(width)))).withColumn("end", F.least("end", (F.col("bucket") + 1) * F.lit(float(width))))


def pieces(rows: DataFrame, key: str, kinds: list[str], width: float) -> DataFrame:
    """key, start, end and a flag for each of ``kinds``: neighbouring boundaries of a clip's intervals and which kinds hold there. ``rows``: key, start, end, kind."""
    steps = stretches(rows.select(key, "start", "end", "kind"), key, width)
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    moved = steps.select(key, "bucket", "kind", F.explode(ends).alias("e")).groupBy(key, "bucket", F.col("e.at").alias("at")).agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("e.d")).otherwise(0)).alias(k) for k in kinds)
    )
    over = Window.partitionBy(key, "bucket").orderBy("at")
    swept = moved.select(key, F.col("at").alias("start"), F.lead("at").over(over).alias("end"), *((F.sum(k).over(over) > 0).alias(k) for k in kinds))
    return swept.where(F.col("end").isNotNull())


def _lasting(when: Column) -> Column:
    return F.sum(F.when(when, F.col("end") - F.col("start")).otherwise(0.0))


def _inside(spans: DataFrame, cut: DataFrame, key: str, ident: list[str], kinds: list[str], width: float) -> DataFrame:
    """``ident`` and, for each kind, the seconds of its pieces inside each span."""
    pairs = I.overlap_join(spans, cut, key, width)
    shared = I.overlap(*(F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")))
    return pairs.groupBy(*(F.col(f"l.{c}").alias(c) for c in ident)).agg(*(F.sum(F.when(F.col(f"r.{k}"), shared).otherwise(0.0)).alias(k) for k in kinds))


def score(
    spans: DataFrame, labels: DataFrame, key: str, ident: str, strict: bool = False, least: float = 0.8, worst: float = 0.5, join_gap: float = 1.0, long_run: float = 5.0, width: float = 600.0
) -> DataFrame:
    """A row for each clip that has labels or spans: counts and seconds that can be added up, see ``rates`` for what is divided.

    ``spans``: key, ident, start, end. ``labels``: key, start, end, kind. ``least`` and ``worst``: share of target in the judged speech of a span
    from which it is right, and up to which it is a hard failure. Runs are target intervals over gaps of ``join_gap`` at most that no other speech parts."""
    truth = read_truth(labels, strict)
    unclear = labels.where(F.col("kind").isin(*UNCLEAR)).select(key, "start", "end", F.lit("unjudged").alias("kind"))
    kinds = ["target", "other", "accepted", "unjudged"]
    every = truth.where("kind in ('target', 'other')").select(key, "start", "end", "kind").unionByName(spans.select(key, "start", "end", F.lit("accepted").alias("kind"))).unionByName(unclear)
    cut = pieces(every, key, kinds, width)
    is_on, hit = F.col("target") & F.col("accepted"), lambda k: F.col(k) & F.col("accepted")
    time = cut.groupBy(key).agg(
        _lasting(F.col("target")).alias("target_seconds"), _lasting(F.col("other")).alias("other_seconds"), _lasting(is_on).alias("accepted_target_seconds"), _lasting(hit("other")).alias("accepted_other_seconds")
    )
    marked = cut.where(F.col("target") | F.col("other") | F.col("unjudged"))
    own = spans.select(key, ident, "start", "end").join(_inside(spans.select(key, ident, "start", "end"), marked, key, [key, ident], ["target", "other", "unjudged"], width), [key, ident], "left")
    speech, share = F.col("target") + F.col("other"), ratio(F.col("target"), F.col("target") + F.col("other"))
    judged = own.groupBy(key).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(speech > 0).alias("judged_spans"), F.count_if(share >= least).alias("correct_spans"), F.count_if(share <= worst).alias("hard_failures"),
        F.coalesce(F.sum("unjudged"), F.lit(0.0)).alias("unjudgeable_seconds_in_spans"), F.count_if(F.col("unjudged") > 0).alias("spans_touching_mixed_or_unsure"),
    )
    ordered = truth.where("kind in ('target', 'other')").select(key, "start", "end", (F.col("kind") == "target").alias("is_target"))
    runs = I.target_runs(ordered, [key], "is_target", join_gap).where(F.col("end") - F.col("start") >= long_run).select(key, "run", "start", "end")
    both = cut.where("target").withColumn("held", F.col("accepted")).withColumn("heard", F.lit(True))
    long = _inside(runs, both, key, [key, "run"], ["heard", "held"], width).groupBy(key).agg(
        F.count(F.lit(1)).alias("long_runs"), F.count_if(F.col("held") >= 0.5 * F.col("heard")).alias("long_runs_half_covered"),
        F.sum("heard").alias("long_run_target_seconds"), F.sum("held").alias("long_run_accepted_seconds"),
    )
    found = labels.select(key).union(spans.select(key)).distinct()
    for part in (time, judged, long):
        found = found.join(part, key, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (*COUNTS, "spans_touching_mixed_or_unsure")]
    nothing = [F.coalesce(c, F.lit(0.0)).alias(c) for c in (*SECONDS, "unjudgeable_seconds_in_spans")]
    return found.select(key, *zero, *nothing)


def pooled(scores: DataFrame, by: list[str]) -> DataFrame:
    """Counts and seconds of clips added up: rates of these are never means of rates."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("clips"), *(F.sum(c).alias(c) for c in (*COUNTS, *SECONDS, *UNCLEAR_MEASURES)))


def rates(scores: DataFrame) -> DataFrame:
    """With precision of spans and of time, recall of time and of long runs; null where there is nothing to divide by."""
    accepted = F.col("accepted_target_seconds") + F.col("accepted_other_seconds")
    return scores.withColumns({
        "span_precision": ratio(F.col("correct_spans"), F.col("judged_spans")), "time_precision": ratio(F.col("accepted_target_seconds"), accepted),
        "time_recall": ratio(F.col("accepted_target_seconds"), F.col("target_seconds")), "long_run_recall": ratio(F.col("long_run_accepted_seconds"), F.col("long_run_target_seconds")),
    })


def by_duration(spans: DataFrame, labels: DataFrame, key: str, ident: str, edges: list[float], strict: bool = False, least: float = 0.8, worst: float = 0.5, width: float = 600.0) -> DataFrame:
    """bucket, low, high and the judged spans of each length of span; lengths without spans are there, with zeros."""
    truth = read_truth(labels, strict).where("kind in ('target', 'other')").select(key, "start", "end", "kind")
    marked = pieces(truth, key, ["target", "other"], width).where("target or other")
    own = spans.select(key, ident, "start", "end")
    own = own.join(_inside(own, marked, key, [key, ident], ["target", "other"], width), [key, ident], "left")
    bounds = [0.0, *sorted(edges), float("inf")]
    place = sum((F.when(F.col("end") - F.col("start") >= e, 1).otherwise(0) for e in sorted(edges)), F.lit(0))
    share = ratio(F.col("target"), F.col("target") + F.col("other"))
    found = own.groupBy(place.alias("bucket")).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.col("target") + F.col("other") > 0).alias("judged_spans"), F.count_if(share >= least).alias("correct_spans"),
        F.count_if(share <= worst).alias("hard_failures"), F.sum(F.col("end") - F.col("start")).alias("seconds"),
    )
    known = spans.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]))], "bucket int, low double, high double")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("spans", "judged_spans", "correct_spans", "hard_failures")]
    return F.broadcast(known).join(found, "bucket", "left").select("bucket", "low", "high", *zero, F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
