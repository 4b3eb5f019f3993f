"""Positional token index: token streams, n-grams, distinct spans, form lexicon, phrase matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import text as X

MAX_WORDS = 5


def segments(docs: DataFrame) -> DataFrame:
    """Lines of documents as segments: doc_id, lang, source, seg (place among all lines), text; blank lines are left out."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("seg", "text"))
    return lines.where(F.trim("text") != "")


def stream(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each token: keys, token_count, pos, tok. One pass over the text, no shuffle."""
    listed = rows.select(*keys, X.normalized_tokens(F.col(text)).alias("toks"))
    return listed.select(*keys, F.size("toks").alias("token_count"), F.posexplode("toks").alias("pos", "tok"))


def phrase_matches(tokens: DataFrame, keys: list[str], candidates: list[list[str]], carry: list[str] = ()) -> DataFrame:
    """Places where consecutive positions hold a member of each candidate set: keys, pos, carry, surface.

    Every side is filtered to its own set before the equality joins on (keys, position), so a rare word keeps the
    join small and lemma sets don't multiply into phrases."""
    if not 1 <= len(candidates) <= MAX_WORDS:
        raise ValueError(f"a phrase has 1 to {MAX_WORDS} words")
    first = tokens.where(F.col("tok").isin(*candidates[0])).select(*keys, *carry, "pos", F.col("tok").alias("t0"))
    for k, some in enumerate(candidates[1:], 1):
        side = tokens.where(F.col("tok").isin(*some)).select(*keys, (F.col("pos") - k).alias("pos"), F.col("tok").alias(f"t{k}"))
        first = first.join(side, [*keys, "pos"])
    return first.select(*keys, "pos", *carry, F.concat_ws(" ", *[f"t{k}" for k in range(len(candidates))]).alias("surface"))


def phrase_matches_windowed(tokens: DataFrame, keys: list[str], phrases: dict[str, list[str]]) -> DataFrame:
    """Many phrases in one pass: the following tokens are looked up with lead(), which costs one shuffle for any number."""
    longest = max(map(len, phrases.values()))
    over = Window.partitionBy(*keys).orderBy("pos")
    ahead = tokens.select(
        *keys, "pos", F.col("tok").alias("t0"),
        *[F.when(F.lead("pos", k).over(over) == F.col("pos") + k, F.lead("tok", k).over(over)).alias(f"t{k}") for k in range(1, longest)],
    )
    hits = [F.when(reduce(lambda a, b: a & b, [F.col(f"t{k}") == w for k, w in enumerate(words)]), F.lit(name)) for name, words in phrases.items()]
    return ahead.select(*keys, "pos", F.explode(F.array_compact(F.array(*hits))).alias("phrase"))


def phrase_places(toks: Column, candidates: list[list[str]]) -> Column:
    """Places in a row's token array where consecutive tokens are members of the candidate sets: no shuffle, no join."""
    n = len(candidates)
    starts = F.sequence(F.lit(0), F.size(toks) - n)
    met = lambda i: reduce(lambda a, b: a & b, [F.get(toks, i + k).isin(*some) for k, some in enumerate(candidates)])
    there = reduce(lambda a, b: a & b, [F.arrays_overlap(toks, F.array(*map(F.lit, some))) for some in candidates])
    return F.when(there & (F.size(toks) >= n), F.filter(starts, met)).otherwise(F.array().cast("array<int>"))


def phrase_hits(rows: DataFrame, keys: list[str], candidates: list[list[str]], text: str = "text") -> DataFrame:
    """keys, pos, surface of a phrase in all rows, matched inside the rows."""
    listed = rows.select(*keys, X.normalized_tokens(F.col(text)).alias("toks"))
    found = listed.select(*keys, "toks", F.explode(phrase_places(F.col("toks"), candidates)).alias("pos"))
    return found.select(*keys, "pos", F.array_join(F.slice("toks", F.col("pos") + 1, len(candidates)), " ").alias("surface"))


def phrase_batch_hits(rows: DataFrame, keys: list[str], phrases: dict[str, list[str]], text: str = "text") -> DataFrame:
    """keys, pos, phrase of many phrases, matched inside the rows in one pass."""
    listed = rows.select(*keys, X.normalized_tokens(F.col(text)).alias("toks"))
    every = F.array(*[F.struct(F.lit(name).alias("phrase"), phrase_places(F.col("toks"), [[w] for w in words]).alias("at")) for name, words in phrases.items()])
    found = listed.select(*keys, F.explode(F.filter(every, lambda h: F.size(h["at"]) > 0)).alias("h"))
    return found.select(*keys, F.explode("h.at").alias("pos"), F.col("h.phrase").alias("phrase"))


def containing_all(tokens: DataFrame, keys: list[str], words: list[str]) -> DataFrame:
    """Keys that have every word (relational division by counting)."""
    some = tokens.where(F.col("tok").isin(*words))
    return some.groupBy(*keys).agg(F.count_distinct("tok").alias("n")).where(F.col("n") == len(set(words))).drop("n")


def ngrams(tokens_array: Column, n: int) -> Column:
    """The n-grams of a token array, joined by spaces."""
    starts = F.sequence(F.lit(1), F.size(tokens_array) - n + 1)
    grams = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(tokens_array, i, n)))
    return F.when(F.size(tokens_array) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_stats(rows: DataFrame, language: str, video: str, max_n: int = 3) -> DataFrame:
    """language, normalized, n, surface, total_count, video_count. All lengths come out of one pass over a text; a gram is
    counted by video first, so that its videos are rows and need no distinct count."""
    both = rows.select(F.col(language).alias("language"), F.col(video).alias("video"), X.tokens(F.col("text")).alias("surf"))
    return gram_totals(grams_by_video(both.withColumn("norm", F.transform("surf", lambda t: X.normalize_token(t))), max_n))


def grams_by_video(listed: DataFrame, max_n: int = 3) -> DataFrame:
    """language, normalized, n, video, count, surface of texts given as arrays of normal forms and surfaces (norm, surf)."""
    both = listed.select(
        "language", "video", *[F.arrays_zip(ngrams(F.col("norm"), n).alias("normalized"), ngrams(F.col("surf"), n).alias("surface")).alias(f"g{n}") for n in range(1, max_n + 1)]
    )
    tagged = [_tagged(n) for n in range(1, max_n + 1)]
    grams = both.select("language", "video", F.explode(F.concat(*tagged)).alias("g")).select("language", "video", "g.*")
    return grams.groupBy("language", "normalized", "n", "video").agg(F.count(F.lit(1)).alias("count"), F.min("surface").alias("surface"))


def gram_totals(by_video: DataFrame) -> DataFrame:
    return by_video.groupBy("language", "normalized", "n").agg(
        F.min("surface").alias("surface"), F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("video_count")
    )


def moved_totals(stats: DataFrame, old: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """``stats`` after the rows ``old`` of ``grams_by_video`` have given way to ``new``: counts move by signed differences, grams that nothing is left
    of go. A gram's surface is looked up again in ``live`` (all rows as they are now) only where a row with it went."""
    key = ["language", "normalized", "n"]
    signed = lambda df, sign: df.select(*key, "surface", (F.col("count") * sign).alias("total_count"), F.lit(sign).cast("long").alias("video_count"))
    moves = signed(old, -1).unionByName(signed(new, 1))
    left = F.min(F.when(F.col("video_count") > 0, F.col("surface"))).alias("surface")
    gone = F.min(F.when(F.col("video_count") < 0, F.col("surface"))).alias("gone")
    marked = stats.select(*key, "surface", "total_count", "video_count").unionByName(moves)
    summed = marked.groupBy(*key).agg(left, gone, F.sum("total_count").alias("total_count"), F.sum("video_count").alias("video_count")).where("total_count > 0")
    open_ = summed.where(F.col("gone") <= F.col("surface"))
    found = live.join(open_.select(*key), key).groupBy(*key).agg(F.min("surface").alias("found"))
    return summed.join(found, key, "left").select(*key, F.coalesce("found", "surface").alias("surface"), "total_count", "video_count")


def _tagged(n: int) -> Column:
    return F.transform(f"g{n}", lambda g: F.struct(g["normalized"].alias("normalized"), F.lit(n).alias("n"), g["surface"].alias("surface")))


def distinct_span_count(token_count: Column, max_n: int) -> Column:
    """Spans of one to max_n tokens in a segment without holes."""
    return sum((F.greatest(F.lit(0), token_count - n + 1) for n in range(1, max_n + 1)), F.lit(0))


def distinct_spans(streams: DataFrame, keys: list[str], max_n: int) -> DataFrame:
    """Distinct character spans of runs of up to max_n tokens over all streams of a segment; a hole ends a run.

    ``streams``: keys, stream, pos, char_start, char_end."""
    over = Window.partitionBy(*keys, "stream").orderBy("pos")
    ends = [F.when(F.lead("pos", k).over(over) == F.col("pos") + k, F.lead("char_end", k).over(over)) for k in range(1, max_n)]
    reached = streams.select(*keys, F.col("char_start").alias("s"), F.array_compact(F.array("char_end", *ends)).alias("ends"))
    spans = reached.select(*keys, "s", F.explode("ends").alias("e"))
    return spans.groupBy(*keys).agg(F.count_distinct(F.struct("s", "e")).alias("n_spans"))


def form_lexicon(tokens: DataFrame, language: str) -> DataFrame:
    """Observed (language, normalized, lemma, upos) with their frequency; nulls count as equal."""
    return tokens.groupBy(language, "normalized", "lemma", "upos").agg(F.count(F.lit(1)).alias("frequency"))


def moved_lexicon(lexicon: DataFrame, old: DataFrame, new: DataFrame, language: str) -> DataFrame:
    """A form lexicon after the tokens ``old`` have given way to ``new``, by signed differences of frequency."""
    key = [language, "normalized", "lemma", "upos"]
    moves = form_lexicon(old, language).withColumn("frequency", -F.col("frequency")).unionByName(form_lexicon(new, language))
    return lexicon.select(*key, "frequency").unionByName(moves).groupBy(*key).agg(F.sum("frequency").alias("frequency")).where("frequency > 0")


def first_of_shared_spans(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Of neighbouring tokens with one span the first, positions counted anew."""
    over = Window.partitionBy(*keys).orderBy("pos")
    span = F.struct("char_start", "char_end")
    kept = tokens.withColumn("_same", F.lag(span).over(over).eqNullSafe(span)).where(~F.col("_same")).drop("_same")
    return kept.withColumn("pos", F.row_number().over(over) - 1)
