"""Alignments between texts and time: groups, gaps, merges, graphs, and what makes them invalid."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_groups(tokens: DataFrame, keys: list[str], word: str) -> DataFrame:
    """Token spans gathered by word: first start, last end, mean score."""
    return tokens.groupBy(*keys, word).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_tokens"))


def with_gaps(groups: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Groups (char_start, char_end) and untimed ones for the text between, before and after them. ``length``: of the text."""
    over = Window.partitionBy(*keys).orderBy("char_start", "char_end")
    placed = groups.select(
        *keys, "char_start", "char_end", F.coalesce(F.lag("char_end").over(over), F.lit(0)).alias("before"), F.lead("char_start").over(over).isNull().alias("last"), length.alias("length")
    )
    own = F.struct("char_start", "char_end", F.lit(True).alias("timed"))
    ahead = F.when(F.col("before") < F.col("char_start"), F.struct(F.col("before").alias("char_start"), F.col("char_start").alias("char_end"), F.lit(False).alias("timed")))
    behind = F.when(F.col("last") & (F.col("char_end") < F.col("length")), F.struct(F.col("char_end").alias("char_start"), F.col("length").alias("char_end"), F.lit(False).alias("timed")))
    return placed.withColumn("g", F.array_compact(F.array(ahead, own, behind))).select(*keys, F.explode("g").alias("g")).select(*keys, "g.*")


def cover_problems(groups: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """Groups that don't follow on the one before, are empty or reach past the text, and texts that aren't covered to the end."""
    over = Window.partitionBy(*keys).orderBy("char_start", "char_end")
    seen = groups.withColumn("before", F.coalesce(F.lag("char_end").over(over), F.lit(0))).withColumn("last", F.lead("char_start").over(over).isNull()).withColumn("length", length)
    problem = (
        F.when(F.col("char_end") <= F.col("char_start"), "empty")
        .when(F.col("char_start") != F.col("before"), "gap or overlap")
        .when(F.col("char_end") > F.col("length"), "past the text")
        .when(F.col("last") & (F.col("char_end") < F.col("length")), "not to the end")
    )
    return seen.withColumn("problem", problem).where("problem is not null").select(*keys, "char_start", "char_end", "problem")


def token_problems(tokens: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Tokens out of bounds, unlike the text at their place, or overlapping the one before without a shared span."""
    over = Window.partitionBy(*keys).orderBy("pos")
    seen = tokens.withColumn("before", F.lag("char_end").over(over)).withColumn("own", F.substring(text, F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    problem = (
        F.when((F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")) | (F.col("char_end") > F.length(text)), "out of bounds")
        .when(F.col("own") != F.col("surface"), "unlike the text")
        .when((F.col("char_start") < F.col("before")) & ~F.coalesce("shared_span", F.lit(False)), "overlap")
    )
    return seen.withColumn("problem", problem).where("problem is not null").select(*keys, "pos", "problem")


def problem_count(text: str, surfaces: list[str]) -> int:
    """How many of ``surfaces``, each sought from the end of the one before, have a problem of ``token_problems``. Where one isn't found the search goes on
    from where it would end."""
    n, at = 0, 0
    for word in surfaces:
        start = text.find(word, at)
        end = start + len(word)
        # what is found lies in the text, is like it and starts at the end of the one before or later
        n += start < 0 or not word
        at = end
    return n


@F.pandas_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("problems", T.LongType())]))
def offset_problems(text: pd.Series, surfaces: pd.Series) -> pd.DataFrame:
    """Tokens of a text, and those whose offsets by a forward search have a problem: in the row, without a row for each token."""
    found = [(len(w), problem_count(t, w)) if w is not None else (0, 0) for t, w in zip(text, surfaces, strict=True)]
    return pd.DataFrame(found, columns=["tokens", "problems"])


def merged_overlaps(groups: Column) -> Column:
    """Groups (char_start, char_end, start, end, confidence), in order, that share characters made one: from the least start to the
    greatest end, in text and in time. Confidence is averaged pair by pair, which depends on the order, so it is a fold over the array."""
    fields = ("char_start", "char_end", "start", "end", "confidence")
    empty = F.array().cast("array<struct<char_start:int,char_end:int,start:double,end:double,confidence:double>>")

    def step(done: Column, g: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        own = F.struct(*[g[c].alias(c) for c in fields])
        joined = F.struct(
            last["char_start"].alias("char_start"), F.greatest(last["char_end"], g["char_end"]).alias("char_end"),
            F.least(last["start"], g["start"]).alias("start"), F.greatest(last["end"], g["end"]).alias("end"),
            ((last["confidence"] + g["confidence"]) / 2).alias("confidence"),
        )
        overlaps = F.coalesce(g["char_start"] < last["char_end"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(own)))

    return F.aggregate(groups, empty, step)


def covering_groups(text: Column, words: Column) -> Column:
    """Timed ``words`` (disjoint, in order) and untimed groups for the text before, between and behind them: text, char_start, char_end, start, end,
    confidence and status (matched, punctuation if a gap has no letter or digit, else unmatched)."""
    piece = lambda lo, hi: F.substr(text, lo + 1, hi - lo)
    nothing = F.lit(None).cast("double")

    def gap(lo: Column, hi: Column) -> Column:
        status = F.when(piece(lo, hi).rlike(r"[\p{L}\p{N}]"), "unmatched").otherwise("punctuation")
        own = F.struct(piece(lo, hi).alias("text"), lo.alias("char_start"), hi.alias("char_end"), nothing.alias("start"), nothing.alias("end"), nothing.alias("confidence"), status.alias("status"))
        return F.when(lo < hi, own)

    def word(w: Column, i: Column) -> Column:
        before = F.coalesce(F.when(i > 0, F.get(words, i - 1)["char_end"]), F.lit(0))
        own = F.struct(
            piece(w["char_start"], w["char_end"]).alias("text"), w["char_start"].alias("char_start"), w["char_end"].alias("char_end"), F.round(w["start"], 3).alias("start"),
            F.round(w["end"], 3).alias("end"), F.round(w["confidence"], 4).alias("confidence"), F.lit("matched").alias("status"),
        )
        return F.array(gap(before, w["char_start"]), own)

    last = F.coalesce(F.try_element_at(words, F.lit(-1))["char_end"], F.lit(0))
    return F.array_compact(F.concat(F.flatten(F.transform(words, word)), F.array(gap(last, F.length(text)))))


def adjacency(edges: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Each source with its sorted targets, and whether it has none. ``sources``: key, source."""
    linked = edges.groupBy(key, "source").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    out = sources.join(linked, [key, "source"], "left")
    return out.select(key, "source", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"), F.col("targets").isNull().alias("unaligned"))


def accounting_problems(edges: DataFrame, unaligned: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Nodes that are neither linked nor listed as unaligned, or both, and links of unknown nodes. All: key, node."""
    flag = lambda df, name: df.select(key, "node").distinct().withColumn(name, F.lit(True))
    every = flag(nodes, "known").join(flag(edges, "linked"), [key, "node"], "full_outer").join(flag(unaligned, "free"), [key, "node"], "full_outer")
    problem = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.col("linked").isNotNull() & F.col("free").isNotNull(), "linked and unaligned")
        .when(F.col("linked").isNull() & F.col("free").isNull(), "missing")
    )
    return every.withColumn("problem", problem).where("problem is not null").select(key, "node", "problem")


def span_agreement(gold: DataFrame, predicted: DataFrame, keys: list[str], span: list[str]) -> DataFrame:
    """Per key: gold, predicted and common spans, and of the common ones those with equal lemmas; lemmas may be null."""
    g = gold.select(*keys, *span, F.col("lemma").alias("gold_lemma"), F.lit(1).alias("g"))
    p = predicted.select(*keys, *span, F.col("lemma").alias("own_lemma"), F.lit(1).alias("p"))
    both = g.join(p, [*keys, *span], "full_outer")
    common = F.col("g").isNotNull() & F.col("p").isNotNull()
    return both.groupBy(*keys).agg(
        F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count_if(common).alias("common"),
        F.count_if(common & F.col("own_lemma").isNotNull()).alias("lemmas"), F.count_if(common & (F.col("own_lemma") == F.col("gold_lemma"))).alias("right_lemmas"),
    )


def list_agreement(gold: Column, predicted: Column) -> list[Column]:
    """The counts of ``span_agreement`` for places in two lists of a row, without nulls: gold, predicted, common, lemmas, right_lemmas."""
    common = F.least(F.size(gold), F.size(predicted)).cast("long")
    equal = F.zip_with(gold, predicted, lambda a, b: a == b)  # null behind the shorter one's end
    right = F.size(F.filter(equal, lambda x: x)).cast("long")
    return [F.size(gold).cast("long").alias("gold"), F.size(predicted).cast("long").alias("predicted"), common.alias("common"), common.alias("lemmas"), right.alias("right_lemmas")]


def proxy_labels(overlaps: DataFrame, unit: str) -> DataFrame:
    """The kind that covers most of each unit, from (unit, kind, seconds); of equals target before other before mixed."""
    rank = F.when(F.col("kind") == "target", 0).when(F.col("kind") == "other", -1).otherwise(-2)
    sums = overlaps.groupBy(unit, "kind").agg(F.sum("seconds").alias("seconds"))
    return sums.groupBy(unit).agg(F.max_by("kind", F.struct("seconds", rank)).alias("label"), F.sum("seconds").alias("covered"))


def pruned(files: DataFrame, keep: DataFrame, keys: list[str], selectors: list[Column]) -> DataFrame:
    """The files that a prune would remove: those that any selector asks for and that aren't kept. Without a selector it refuses."""
    if not selectors:
        raise ValueError("a prune needs a selector")
    asked = F.lit(False)
    for s in selectors:
        asked = asked | F.coalesce(s, F.lit(False))
    return files.where(asked).join(keep, keys, "left_anti")
