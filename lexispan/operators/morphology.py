"""Scores of analyses against gold words, and of lemma retrieval against gold lemmas.

Words are matched by their characters' place, words of one place (a contracted token) by their order. A lexicon of training forms tells which words an
analyzer can't have seen and which have several analyses. Everything is joins and counts; what is divided is divided last.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.functions import text as X
from lexispan.functions.measures import ratio

NOT_LEXICAL = ("PUNCT", "SYM")
COUNTS = (
    "gold", "aligned", "predicted", "strict_correct", "production_correct", "unseen_gold", "unseen_predicted", "unseen_correct", "ambiguous_gold", "ambiguous_predicted",
    "ambiguous_correct", "missing_lemma", "wrong_lemma", "unaligned",
)


@F.pandas_udf(T.StringType())
def strict_key(text: pd.Series) -> pd.Series:
    """Composed and case folded, accents kept; null for what says nothing."""
    return text.map(lambda t: None if t is None or t == "_" or not t.strip() else unicodedata.normalize("NFC", t).casefold())


def production_key(text: Column) -> Column:
    """The index's normal form; null for what says nothing."""
    return X.normal_token_udf(F.when((text != "_") & (F.trim(text) != ""), text))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    same = Window.partitionBy(*keys, "start", "end")
    return rows.withColumn("k", F.row_number().over(same.orderBy("ord"))).withColumn("n", F.count(F.lit(1)).over(same))


def word_outcomes(gold: DataFrame, predicted: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each gold word that isn't a mark, with upos and a flag for each of COUNTS.

    ``gold``: keys, start, end, ord, form, lemma, upos. ``predicted``: keys, start, end, ord, lemma. ``lexicon``: form, lemma, upos of training words."""
    known = lexicon.select(strict_key("form").alias("strict"), "lemma", "upos").distinct().groupBy("strict").agg(F.count(F.lit(1)).alias("analyses"))
    words = _placed(gold.where(F.col("upos").isNull() | ~F.col("upos").isin(*NOT_LEXICAL)), keys)
    own = _placed(predicted, keys).select(*keys, "start", "end", "k", F.col("lemma").alias("found"), F.lit(True).alias("met"))
    both = words.withColumn("strict", strict_key("form")).join(own, [*keys, "start", "end", "k"], "left").join(known, "strict", "left")
    both = both.withColumns({"want_s": strict_key("lemma"), "got_s": strict_key("found"), "want_p": production_key(F.col("lemma")), "got_p": production_key(F.col("found"))})
    met, told = F.coalesce("met", F.lit(False)), F.col("met").isNotNull() & F.col("got_s").isNotNull()
    right, unseen, several = told & F.col("got_s").eqNullSafe(F.col("want_s")), F.col("analyses").isNull(), F.coalesce(F.col("analyses") > 1, F.lit(False))
    flags = dict(zip(COUNTS, (
        F.lit(True), met, told, right, told & F.col("got_p").eqNullSafe(F.col("want_p")), unseen, unseen & told, unseen & right, several, several & told, several & right,
        met & ~told, told & ~right, ~met,
    ), strict=True))
    return both.select(*keys, "start", "end", "ord", F.coalesce("upos", F.lit("NULL")).alias("upos"), *(f.alias(n) for n, f in flags.items()))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Counts of all words (upos null) and by part of speech."""
    return outcomes.groupingSets([[], ["upos"]], "upos").agg(*(F.count_if(F.col(c)).alias(c) for c in COUNTS))


def outcome_rates(counts: DataFrame) -> DataFrame:
    part = lambda top, bottom: F.round(ratio(F.col(top), F.col(bottom)), 6)
    return counts.withColumns({
        "coverage": part("predicted", "gold"), "strict_accuracy": part("strict_correct", "predicted"), "production_accuracy": part("production_correct", "predicted"),
        "unseen_coverage": part("unseen_predicted", "unseen_gold"), "unseen_accuracy": part("unseen_correct", "unseen_predicted"),
        "ambiguous_coverage": part("ambiguous_predicted", "ambiguous_gold"), "ambiguous_accuracy": part("ambiguous_correct", "ambiguous_predicted"),
    })


def boundary_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: places of gold and predicted words and those in common with precision, recall and their mean; places of several gold words
    and those where the same words were found in order; and by how many words the places differ. ``gold`` and ``predicted``: keys, start, end, ord, form."""

    def spans(rows: DataFrame, name: str) -> DataFrame:
        forms = rows.select(*keys, "start", "end", "ord", strict_key("form").alias("f"))
        listed = forms.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_list(F.struct("ord", "f"))).alias("w"))
        return listed.select(*keys, "start", "end", F.transform("w", lambda x: x["f"]).alias(name))

    lexical = gold.where(F.col("upos").isNull() | ~F.col("upos").isin(*NOT_LEXICAL))
    both = spans(lexical, "g").join(spans(predicted, "p"), [*keys, "start", "end"], "full_outer")
    is_gold, is_own, several = F.col("g").isNotNull(), F.col("p").isNotNull(), F.coalesce(F.size("g") > 1, F.lit(False))
    ng, np_ = F.when(is_gold, F.size("g")).otherwise(0), F.when(is_own, F.size("p")).otherwise(0)
    sums = both.agg(
        F.count_if(is_gold).alias("gold_boundaries"), F.count_if(is_own).alias("predicted_boundaries"), F.count_if(is_gold & is_own).alias("correct_boundaries"),
        F.count_if(several).alias("gold_mwt"), F.count_if(several & F.coalesce(F.col("g") == F.col("p"), F.lit(False))).alias("correct_mwt"),
        F.coalesce(F.sum(F.when(is_gold, F.abs(ng - np_) + F.greatest(ng - np_, F.lit(0)))), F.lit(0)).alias("tokenization_mismatch"),
    )
    precision, recall = ratio(F.col("correct_boundaries"), F.col("predicted_boundaries")), ratio(F.col("correct_boundaries"), F.col("gold_boundaries"))
    return sums.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.coalesce(F.round(2 * precision * recall / F.when(precision + recall > 0, precision + recall), 6), F.lit(0.0))})


def query_keys(queries: DataFrame, lexicon: DataFrame, analyzed: DataFrame | None = None) -> DataFrame:
    """query_id, route, key: what each query looks for. Exact: its normal form. Lemma: what an analyzer made of it (``analyzed``: query_id, key) and, of single
    words, all lemmas that training words (``lexicon``: form, lemma) of that form have."""
    told = queries.select("query_id", F.array_join(F.transform(X.tokens_with_spans("surface"), lambda t: t["tok"]), " ").alias("key"))
    forms = lexicon.select(production_key(F.col("form")).alias("key"), production_key(F.col("lemma")).alias("lemma")).where("key is not null and lemma is not null").distinct()
    lemmas = told.where(~F.col("key").contains(" ")).join(forms, "key").select("query_id", F.col("lemma").alias("key"))
    if analyzed is not None:
        lemmas = lemmas.union(analyzed.select("query_id", "key"))
    keys = told.select("query_id", F.lit("exact").alias("route"), "key").union(lemmas.select("query_id", F.lit("lemma"), "key"))
    return keys.where("key is not null and key != ''").distinct()


def retrieval_scores(queries: DataFrame, keys: DataFrame, streams: DataFrame, gold: DataFrame, place: list[str], times: str | None = None) -> DataFrame:
    """A row for each query: occurrences by route and by both, what lemmas add, and recall and precision against the gold occurrences of its intended lemma.

    ``queries``: query_id, intended_lemma, selection_class. ``streams``: route, key, place. ``gold``: lemma, place. Recall is null without gold occurrences,
    precision without hits; the precision of both routes together is told for ambiguous forms. ``times``: one of ``place``, a number of
    occurrences that a row stands for."""
    hits = keys.join(streams, ["route", "key"]).select("query_id", *place, (F.col("route") == "exact").alias("x"), (F.col("route") == "lemma").alias("l"), F.lit(False).alias("g"))
    wanted = queries.select("query_id", strict_key("intended_lemma").alias("strict")).where("strict is not null")
    right = gold.select(strict_key("lemma").alias("strict"), *place).join(wanted, "strict").select("query_id", *place, F.lit(False).alias("x"), F.lit(False).alias("l"), F.lit(True).alias("g"))
    seen = hits.union(right).groupBy("query_id", *place).agg(*(F.bool_or(c).alias(c) for c in "xlg"))
    x, l, g = F.col("x"), F.col("l"), F.col("g")
    count = lambda c, n: F.sum(F.when(c, F.col(times) if times else F.lit(1)).otherwise(0)).alias(n)
    sums = seen.groupBy("query_id").agg(
        count(x, "exact_count"), count(l, "lemma_count"), count(x | l, "auto_count"), count(l & ~x, "deduplicated_expansion"),
        count(g, "gold_count"), count(l & g, "lg"), count((x | l) & g, "ag"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in sums.columns if c != "query_id"]
    joined = queries.join(sums, "query_id", "left").select(*queries.columns, *zero)
    ambiguous = F.when(F.col("selection_class") == "ambiguous_form", ratio(F.col("ag"), F.col("auto_count")))
    return joined.select(
        *queries.columns, "exact_count", "lemma_count", "auto_count", "deduplicated_expansion", F.round(ratio(F.col("lg"), F.col("gold_count")), 6).alias("candidate_lemma_recall"),
        F.round(ratio(F.col("lg"), F.col("lemma_count")), 6).alias("intended_lemma_precision"), F.round(ambiguous, 6).alias("ambiguous_union_precision"),
    )
