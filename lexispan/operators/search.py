"""Phrase search: matches merged over routes, scored, ranked, diversified over videos; suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import ids
from lexispan.functions import measures as M

MODES, ORDERS = ("auto", "exact", "lemma"), ("ranked", "random")
MAX_CHARS, MAX_WORDS, MAX_LIMIT = 200, 5, 50
#: Most widely used n-grams among which suggestions are sought.
SUGGESTED = 1000


class SearchError(ValueError):
    """A query that can't be answered."""


def validated(query: str, words: list[str], mode: str, order: str, limit: int, seed: str | None) -> None:
    if not query.strip() or not words:
        raise SearchError("the query has no words")
    if len(query) > MAX_CHARS:
        raise SearchError(f"the query is longer than {MAX_CHARS} characters")
    if len(words) > MAX_WORDS:
        raise SearchError(f"the query has more than {MAX_WORDS} words")
    if mode not in MODES:
        raise SearchError(f"unknown match mode {mode!r}")
    if order not in ORDERS:
        raise SearchError(f"unknown order {order!r}")
    if order == "random" and seed is None:
        raise SearchError("random order needs a seed")
    if order != "random" and seed is not None:
        raise SearchError("a seed goes with random order only")
    if not 1 <= limit <= MAX_LIMIT:
        raise SearchError(f"the limit is 1 to {MAX_LIMIT}")


def merged(surface: DataFrame, lemma: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both routes' occurrences, one row for each: in_exact, in_lemma, and the surface of the better route."""
    both = surface.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("l"), "surface").unionByName(
        lemma.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("l"), "surface")
    )
    return both.groupBy(*keys).agg(
        F.max("x").alias("in_exact"), F.max("l").alias("in_lemma"), F.min_by("surface", F.struct((1 - F.col("x")), "surface")).alias("surface")
    )


def totals(occurrences: DataFrame) -> DataFrame:
    """Distinct occurrences by mode, before anything is dropped."""
    return occurrences.agg(
        F.sum("in_exact").alias("exact"), F.sum("in_lemma").alias("lemma"), F.count(F.lit(1)).alias("auto")
    )


def best_of_segment(scored: DataFrame, segment: list[str], order: list) -> DataFrame:
    over = Window.partitionBy(*segment).orderBy(*order)
    return scored.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def diversified(rows: DataFrame, tier: str, video: str, order: list, limit: int) -> DataFrame:
    """Round robin over videos inside each tier: a video's k-th best row comes after all videos' better rounds.

    The passes that allow one, two, ... rows a video have a closed form: the row's number within its tier and video.
    """
    over = Window.partitionBy(tier, video).orderBy(*order)
    ranked = rows.withColumn("round", F.row_number().over(over))
    page = ranked.orderBy(tier, "round", *order).limit(limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(tier, "round", *order)))


def random_page(rows: DataFrame, ident: str, seed: str, limit: int) -> DataFrame:
    return rows.withColumn("draw", ids.hash_order(seed, F.col(ident))).orderBy("draw").limit(limit)


def suggestions(stats: DataFrame, stopword, limit: int, pool: int = SUGGESTED) -> DataFrame:
    """From the most widely used n-grams: half single words that aren't stop words, the rest phrases that aren't all
    stop words or numbers, each filled up from the other if it runs short. ``stopword``: column -> column."""
    numeric = lambda t: t.rlike(r"^\p{N}+$")
    top = stats.orderBy(F.desc("video_count"), F.desc("total_count"), "n", "normalized").limit(pool)
    fine = top.where(~F.forall(F.split("normalized", " "), lambda t: stopword(t) | numeric(t)))
    kind = F.when(F.col("n") == 1, 0).otherwise(1)
    order = [F.desc("video_count"), F.desc("total_count"), "n", "normalized"]
    numbered = fine.withColumn("kind", kind).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))
    quota = F.when(F.col("kind") == 0, (limit + 1) // 2).otherwise(limit // 2)
    return numbered.withColumn("over", (F.col("place") > quota).cast("int")).orderBy("over", *order).limit(limit).drop("over", "place")


def scored(hits: DataFrame, n: int) -> DataFrame:
    """``hits`` (quality, accent_exact, pos, token_count) with their score."""
    return hits.withColumn("score", M.match_score(F.col("quality"), F.col("accent_exact"), F.col("pos"), F.lit(n), F.col("token_count")))
