"""Eligibility, seeded orders, round robin, stratified and spaced samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import ids
from lexispan.sources.scratch import written


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that rejects a row, or ``eligible``."""
    out = F.lit("eligible")
    for name, rejects in reversed(rules):
        out = F.when(rejects, name).otherwise(out)
    return out


def all_failing(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that reject a row, in order."""
    return F.array_compact(F.array(*[F.when(rejects, F.lit(name)) for name, rejects in rules]))


def hash_sample(rows: DataFrame, ident: str, seed: str, n: int) -> DataFrame:
    return rows.withColumn("draw", ids.hash_order(seed, F.col(ident))).orderBy("draw").limit(n)


def round_robin(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows when groups take turns, each giving its rows in order."""
    numbered = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.orderBy("round", group).limit(n)


def per_cell(rows: DataFrame, cells: list[str], ident: str, seed: str, k: int) -> DataFrame:
    """``k`` rows of every cell by seeded order."""
    over = Window.partitionBy(*cells).orderBy(ids.hash_order(seed, F.col(ident)), ident)
    return rows.withColumn("place", F.row_number().over(over)).where(F.col("place") <= k)


def spaced(rows: DataFrame, key: str, ident: str, seed: str, gap: float, cap: int) -> DataFrame:
    """In seeded order, the rows that lie ``gap`` or more from all taken before them in the same key, ``cap`` at most.

    Each choice depends on those before, within one key (a video), so keys are folded apart."""
    kinds = dict(rows.dtypes)
    drawn = rows.withColumn("draw", ids.hash_order(seed, F.col(ident))).select(key, ident, "start", "end", "draw")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple] = []
        for row in pdf.sort_values("draw").itertuples(index=False):
            if len(taken) < cap and all(row.start >= t.end + gap or row.end + gap <= t.start for t in taken):
                taken.append(row)
        return pd.DataFrame(taken, columns=list(pdf.columns))

    return drawn.groupBy(key).applyInPandas(choose, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, start double, end double, draw string")


def evenly_spaced(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """``k`` rows of each key at even distances from first to last (places rounded half to even)."""
    over = Window.partitionBy(*keys)
    placed = rows.withColumn("_p", F.row_number().over(over.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(over))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / max(1, k - 1)).cast("long"))
    return placed.where(F.array_contains(wanted, F.col("_p").cast("long"))).drop("_p", "_n")


def apart(rows: DataFrame, video: str, gap: float, width: float) -> DataFrame:
    """``rows`` (order, video, start, end) with ``far``: whether the row is taken when rows are gone through by ``order`` and one is taken if it lies ``gap`` or
    more from all taken before it in its video.

    A row is settled once its rivals before it are: in each round the rows that come first in all stretches of ``width`` seconds which they touch are
    taken, and rows near to them are refused. In a random order that takes a few rounds, each a join by stretches, so a video of any length is dealt to many tasks."""
    stretch = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") + gap) / width))).alias("stretch")
    left, settled = rows.select("order", video, "start", "end"), []
    while True:
        dealt = left.select("order", video, "start", "end", stretch)
        first = dealt.groupBy(video, "stretch").agg(F.min("order").alias("first"))
        taken = dealt.join(first, [video, "stretch"]).groupBy("order").agg(F.bool_and(F.col("order") == F.col("first")).alias("taken")).where("taken")
        x, y = dealt.alias("x"), dealt.join(taken, "order").alias("y")
        near = (F.col("x.start") < F.col("y.end") + gap) & (F.col("y.start") < F.col("x.end") + gap) & (F.col("x.order") != F.col("y.order"))
        refused = x.join(y, (F.col(f"x.{video}") == F.col(f"y.{video}")) & (F.col("x.stretch") == F.col("y.stretch")) & near).select("x.order").distinct().withColumn("refused", F.lit(True))
        after = written(left.join(taken, "order", "left").join(refused, "order", "left"), "spaced-sample")
        settled.append(after.where("taken or refused").select("order", F.coalesce("taken", F.lit(False)).alias("far")))
        left = after.where("taken is null and refused is null").drop("taken", "refused")
        if left.isEmpty():
            break
    far = settled[0]
    for more in settled[1:]:
        far = far.union(more)
    return rows.join(far, "order", "left")


def _within_caps(rows: DataFrame, video: str, gap: float, cap: int, width: float) -> DataFrame:
    """``rows`` with ``fate``: taken, neighbour or video_cap. A video's cap only ends what is taken of it, so it can be applied behind the spacing."""
    placed = apart(rows, video, gap, width)
    last = placed.where("far").withColumn("n", F.row_number().over(Window.partitionBy(video).orderBy("order"))).where(F.col("n") == cap).select(video, F.col("order").alias("full"))
    capped = placed.join(last, video, "left")
    fate = F.when(F.col("order") > F.col("full"), "video_cap").when(F.col("far"), "taken").otherwise("neighbour")
    return capped.withColumn("fate", fate).drop("far", "full")


def quota_sample(rows: DataFrame, strata: list[tuple], stratum: str, video: str, ident: str, seed: str, cap: int, gap: float, width: float = 60.0) -> DataFrame:
    """``rows`` (ident, video, stratum, start, end) with ``order`` and ``fate``: what a pass in seeded order does with each. A row is passed over (quota) once its stratum has
    what it asks for, then refused if its video has ``cap`` rows, then if it lies nearer than ``gap`` to a row taken before. ``strata``: (stratum, requested).

    The pass depends on all before it, but a quota only cuts a stratum off at one place. With these places known the videos don't
    depend on each other. Places that the pass without quotas gives are tried; they are right if the pass with them gives the same ones. If not, the
    earliest of them is right, for nothing before it was cut off, and is kept."""
    requested = dict(strata)
    drawn = written(rows.withColumn("order", F.concat(ids.hash_order(seed, F.col(ident)), F.lit(" "), F.col(ident).cast("string"))), "sample-rows")
    known = F.create_map(*(F.lit(x) for pair in requested.items() for x in pair))

    def passed(places: dict) -> tuple[DataFrame, dict]:
        cut = F.try_element_at(F.create_map(*(F.lit(x) for pair in places.items() for x in pair)), F.col(stratum)) if places else F.lit(None)
        pool = drawn.withColumn("cut", cut.cast("string"))
        open_ = pool.where("cut is null or order <= cut").drop("cut")
        fates = written(_within_caps(open_, video, gap, cap, width).unionByName(pool.where("order > cut").drop("cut").withColumn("fate", F.lit("quota"))), "sample-fates")
        taken = fates.where("fate = 'taken'").withColumn("n", F.row_number().over(Window.partitionBy(stratum).orderBy("order"))).where(F.col("n") == known[F.col(stratum)])
        return fates, {r[stratum]: r["order"] for r in taken.select(stratum, "order").collect()}  # one for each stratum at most

    sure: dict = {}
    while True:
        fates, found = passed(sure)
        if found == sure:
            return fates
        tried, again = passed(found)
        if again == found:
            return tried
        earliest = min((k for k in found if k not in sure), key=found.get, default=None)
        sure = {**{k: found[k] for k in sure if k in found}, **({earliest: found[earliest]} if earliest is not None else {})}


def sample_report(fates: DataFrame, strata: list[tuple], stratum: str, video: str) -> DataFrame:
    """A row for each stratum: requested, eligible rows and videos, selected rows and videos, missing; and how many rows were refused and why."""
    found = fates.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("eligible"), F.count_distinct(video).alias("eligible_videos"), F.count_if(F.col("fate") == "taken").alias("selected"),
        F.count_distinct(F.when(F.col("fate") == "taken", F.col(video))).alias("selected_videos"), F.count_if(F.col("fate") == "video_cap").alias("rejected_video_cap"),
        F.count_if(F.col("fate") == "neighbour").alias("rejected_neighbour"), F.count_if(F.col("fate") == "quota").alias("passed_over"),
    )
    kind = dict(fates.dtypes)[stratum]
    asked = fates.sparkSession.createDataFrame(strata, f"`{stratum}` {kind}, requested int")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c != stratum]
    out = F.broadcast(asked).join(found, stratum, "left").select(stratum, "requested", *zero)
    return out.withColumn("missing", F.greatest(F.col("requested") - F.col("selected"), F.lit(0)))
