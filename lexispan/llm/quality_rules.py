r"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression over the document's own text, so the operator has
no shuffle, no user function and no state: it reads, projects and writes.

Words are the runs of ``[^\x20\x09-\x0D]``. A null or empty text has no words and fails
the base rule. Nulls in other columns and other columns altogether have no effect.
Repeated rows each get the same answer; an empty table gives no rows. A very long text
costs time in proportion to n log n of its words, only if it repeats an eight-word window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import documents

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "aber als am auch auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht sich sie und von zu "
    "au aux ce dans de du elle en est et il la le les mais ne nous ou par pas pour que qui se sur un une vous "
    "al como con del el ella en es la las lo los más no o para pero por que se si su un una y ya"
).split()

#: measure, least and greatest value allowed (None: no bound). A document is kept if every measure is within bounds.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_ratio", 0.04, None),
    ("duplicate_line_ratio", None, 0.6),
]

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _windows(words: Column) -> Column:
    """A fingerprint for each window of eight words, in order; empty if there are fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    bound = F.transform(F.array(hashes), over)[0]
    return F.when(F.size(words) >= WINDOW, bound).otherwise(F.array().cast("array<bigint>"))


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; works only where some window does."""

    def positions(s: Column) -> Column:
        n = F.size(s)
        index = F.sequence(F.lit(0), n - 1)
        at = lambda k: F.get(s, k)["w"]
        twice = lambda k: ((k > 0) & (at(k - 1) == at(k))) | ((k < n - 1) & (at(k + 1) == at(k)))
        return F.array_sort(F.transform(F.filter(index, twice), lambda k: F.get(s, k)["i"]))

    marked = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ordered = F.array(F.sort_array(marked))
    starts = F.transform(ordered, positions)[0]
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("covered"))
    covered = F.aggregate(
        starts,
        none,
        lambda a, i: F.struct(
            (i + WINDOW).alias("end"),
            (a["covered"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("covered"),
        ),
        lambda a: a["covered"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("bigint"))


def compiled(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    """The threshold table as one boolean column."""
    rule = F.lit(True)
    for measure, least, greatest in thresholds:
        if least is not None:
            rule = rule & (F.col(measure) >= least)
        if greatest is not None:
            rule = rule & (F.col(measure) <= greatest)
    return rule


def quality_measures(docs: DataFrame, keep: list[str], thresholds=None) -> DataFrame:
    """``keep`` columns of ``docs`` with counts, ratios, ``base_failed`` and ``kept``; measures start with ``q_`` inside."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        _words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
    )
    second = first.select("row", "words", "lines", "n_symbols", _windows(F.col("words")).alias("windows"))
    stop = [F.lit(w) for w in dict.fromkeys(STOP_WORDS)]
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    counted = second.select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("windows")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: bare(w).isin(*stop))).cast("bigint").alias("n_stop_words"),
    )
    some = F.greatest("n_words", F.lit(1).cast("bigint"))
    ratios = counted.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / some,
            "symbols_per_word": F.col("n_symbols") / some,
            "stop_word_ratio": F.col("n_stop_words") / some,
            "duplicate_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1).cast("bigint")),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    return ratios.withColumn("kept", ~F.col("base_failed") & compiled(THRESHOLDS if thresholds is None else thresholds))


def quality_filter(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject; the columns stay as they are.

    The verdict passes a generator, which keeps the filter from being pushed below the projections, where each measure
    would be worked out again."""
    kept = quality_measures(docs, docs.columns).select("row", F.explode(F.array("kept")).alias("stays")).where("stays")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_measures(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", "n_lines",
    )
