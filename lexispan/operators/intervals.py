"""Interval algebra on rows of (key, start, end): union, coverage, overlap, windows, runs, folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """Merged intervals of each key; those that touch, or lie ``gap`` apart at most, become one. Empty ones are dropped."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where("end > start").withColumn("opens", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def union_length(rows: DataFrame, keys: list[str]) -> DataFrame:
    return islands(rows, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count(F.lit(1)).alias("n_islands"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of overlapping intervals of one key, as columns of ``left`` and ``right`` (aliases l and r).

    Time is cut into buckets and an interval is dealt to those it touches, so that a hot key's intervals meet in many
    small groups; a pair is taken in the bucket of the later start only."""
    deal = lambda df: df.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")))
    )
    l, r = deal(left).alias("l"), deal(right).alias("r")
    meets = (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    home = F.floor(F.greatest("l.start", "r.start") / width).cast("long")
    return l.join(r, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._bucket") == F.col("r._bucket")) & meets & (F.col("l._bucket") == home))


def sliding_windows(rows: DataFrame, length: float, step: float) -> DataFrame:
    """Windows over each interval; the last is moved to end with it, and a short interval is one window."""
    span = F.col("end") - F.col("start")
    n = F.when(span <= length, 0).otherwise(F.ceil((span - length) / step)).cast("int")
    numbered = rows.withColumn("w", F.explode(F.sequence(F.lit(0), n)))
    start = F.greatest(F.col("start"), F.least(F.col("start") + F.col("w") * step, F.col("end") - length))
    return numbered.withColumn("w_start", start).withColumn("w_end", F.least(F.col("end"), start + length))


def even_pieces(rows: DataFrame, longest: float) -> DataFrame:
    """Intervals that are too long cut to equal pieces."""
    span = F.col("end") - F.col("start")
    parts = F.greatest(F.lit(1), F.ceil(span / longest - 1e-9)).cast("int")
    cut = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    size = span / F.col("parts")
    return cut.select(
        *[c for c in rows.columns if c not in ("start", "end")],
        (F.col("start") + F.col("part") * size).alias("start"),
        F.when(F.col("part") == F.col("parts") - 1, F.col("end")).otherwise(F.col("start") + (F.col("part") + 1) * size).alias("end"),
    )


def capped_merge(rows: DataFrame, key: str, gap: float, longest: float) -> DataFrame:
    """Neighbouring pieces joined over small gaps while the whole stays short enough: a greedy fold in time order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for start, end in pdf.sort_values(["start", "end"])[["start", "end"]].itertuples(index=False):
            if out and start - out[-1][1] <= gap and end - out[-1][0] <= longest:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        return pd.DataFrame({key: pdf[key].iloc[0], "start": [x for x, _ in out], "end": [y for _, y in out]})

    kind = dict(rows.dtypes)[key]
    return even_pieces(rows.select(key, "start", "end"), longest).groupBy(key).applyInPandas(fold, f"`{key}` {kind}, start double, end double")


def label_runs(windows: DataFrame, keys: list[str], label: str, probability: str | None = None) -> DataFrame:
    """Runs of equal labels over ordered windows, with the mean ``probability`` of their windows. Where a run's first or last
    window overlaps its neighbour the two are split halfway; a gap between them stays. Of windows with the same start and end that are first or last, the one
    that comes first in the order counts."""
    over = Window.partitionBy(*keys).orderBy("start", "end")
    marked = windows.withColumn("_new", F.when(F.lag(label).over(over).eqNullSafe(F.col(label)) & F.lag("start").over(over).isNotNull(), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_before", F.lag("end").over(over)).withColumn("_after", F.lead("start").over(over))
    marked = marked.withColumn("_place", F.row_number().over(over))
    first, last = F.struct("start", "end", "_place"), F.struct("start", "end", -F.col("_place"))
    runs = marked.groupBy(*keys, "run").agg(
        F.min_by(label, first).alias(label), F.min_by(F.struct("start", "_before"), first).alias("f"), F.max_by(F.struct("end", "_after"), last).alias("l"),
        F.count(F.lit(1)).alias("n"), *([F.avg(probability).alias("mean")] if probability else []),
    )
    start = F.greatest("f.start", (F.col("f.start") + F.col("f._before")) / 2)
    end = F.least("l.end", (F.col("l.end") + F.col("l._after")) / 2)
    return runs.select(*keys, "run", label, start.alias("start"), end.alias("end"), "n", *(["mean"] if probability else []))


def target_runs(rows: DataFrame, keys: list[str], target: str, gap: float) -> DataFrame:
    """Target intervals joined over gaps of ``gap`` at most; any other interval between them parts them."""
    over = Window.partitionBy(*keys).orderBy("start", "end")
    joins = F.col(target) & F.lag(target).over(over) & (F.col("start") - F.lag("end").over(over) <= gap)
    numbered = rows.withColumn("_new", F.when(joins, 0).otherwise(1))
    numbered = numbered.withColumn("run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(target))
    return numbered.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def boundary_pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The line cut at all starts and ends: neighbouring distinct boundaries of each key."""
    points = rows.select(*keys, F.col("start").alias("at")).unionByName(rows.select(*keys, F.col("end").alias("at"))).distinct()
    over = Window.partitionBy(*keys).orderBy("at")
    return points.withColumn("next", F.lead("at").over(over)).where("next is not null")


def viterbi(rows: DataFrame, key: str, probability: str, penalty: float) -> DataFrame:
    """Two-state smoothing: the state sequence of greatest likelihood where each change of state costs ``penalty``.

    ``rows``: key, ord, probability of state 1 (null: no evidence). A sequence is one group; sequences are many."""

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("ord")
        p = pdf[probability].fillna(0.5).clip(1e-4, 1 - 1e-4).to_numpy()
        gain = np.stack([np.log(1 - p), np.log(p)], 1)
        back = np.zeros((len(p), 2), np.int8)
        best = gain[0].copy()
        for i in range(1, len(p)):
            stay, change = best, best[::-1] - penalty
            back[i] = np.where(stay >= change, [0, 1], [1, 0])
            best = np.maximum(stay, change) + gain[i]
        state = np.zeros(len(p), np.int32)
        state[-1] = int(best[1] >= best[0])
        for i in range(len(p) - 1, 0, -1):
            state[i - 1] = back[i, state[i]]
        return pd.DataFrame({key: pdf[key], "ord": pdf["ord"], "state": state})

    kinds = dict(rows.dtypes)
    return rows.select(key, "ord", probability).groupBy(key).applyInPandas(decode, f"`{key}` {kinds[key]}, ord {kinds['ord']}, state int")


def point_lookup(points: DataFrame, spans: DataFrame, key: str, width: float) -> DataFrame:
    """Points joined to the intervals [start, end) of their key that hold them (aliases p and s), by time buckets."""
    p = points.withColumn("_bucket", F.floor(F.col("at") / width).cast("long")).alias("p")
    last = F.floor(F.col("end") / width).cast("long")
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), last))).alias("s")
    inside = (F.col("p.at") >= F.col("s.start")) & (F.col("p.at") < F.col("s.end"))
    return p.join(s, (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._bucket") == F.col("s._bucket")) & inside)


