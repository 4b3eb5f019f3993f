"""Forced alignment of texts to given frame-wise log probabilities (connectionist temporal classification).

A text becomes a sequence of vocabulary ids with their places in the text; the most likely path through frames and ids gives each id its
frames; ids are gathered to words, words to groups that cover the text. Everything but the path is joins and windows; the path is
found row by row (a clip's frames are one array), in memory of a few times the root of the frames times the ids.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.functions.measures import alignment_status, letter_coverage
from lexispan.operators import alignment as A

#: Frames to this power are worked out again at a time on the way back.
BLOCK_ROOT = 0.5
TOKEN_SPANS = T.ArrayType(
    T.StructType([T.StructField("token", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
)


def _bare_letters() -> tuple[str, str]:
    """Letters of Latin, Greek and Cyrillic with marks, and the same letters without, case kept."""
    source, target = [], []
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn")
        if chr(code).isalpha() and len(bare) == 1 and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target)


MARKED, BARE = _bare_letters()


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def mapped_characters(text: Column, table: Column | None = None) -> Column:
    """Characters as the vocabulary's script has them, each with the place (start, end) of the character that it comes from. ``table``: a map
    of a character to any number of others, none for one that has no sound; what it doesn't know stays."""
    out = lambda c: characters(F.coalesce(F.try_element_at(table, c), c)) if table is not None else F.array(c)
    places = lambda c, i: F.transform(out(c), lambda o: F.struct(o.alias("char"), i.alias("start"), (i + 1).alias("end")))
    return F.flatten(F.transform(characters(text), places))


def vocabulary_id(char: Column, vocabulary: Column) -> Column:
    """The id of a character as it is, in lower or upper case, or without its marks; null if it has none."""
    bare = F.translate(char, MARKED, BARE)
    return F.coalesce(*(F.try_element_at(vocabulary, c) for x in (char, bare) for c in (x, F.lower(x), F.upper(x))))


def token_plans(rows: DataFrame, keys: list[str], text: Column, vocabulary: Column, delimiter: int | None = None, table: Column | None = None) -> DataFrame:
    """``keys`` and plan: the ids to align in order, with the word they belong to and their place in the text (-1 for a delimiter between words).
    Characters without an id are left out, words without any don't count. A text without ids has no row."""
    chars = rows.select(*keys, F.posexplode(mapped_characters(text, table)).alias("ord", "c")).select(*keys, "ord", "c.*", vocabulary.alias("v"))
    ordered = Window.partitionBy(*keys).orderBy("ord")
    spaces = F.sum(F.when(F.trim(F.translate("char", "\t\n\x0b\x0c\r ", "      ")) == "", 1).otherwise(0)).over(ordered)
    ids = chars.select(*keys, "ord", "char", "start", "end", vocabulary_id(F.col("char"), F.col("v")).alias("id"), spaces.alias("gap"))
    ids = ids.where(F.col("id").isNotNull() & ~F.col("char").rlike(r"^\s$"))
    words = ids.withColumn("word", F.dense_rank().over(Window.partitionBy(*keys).orderBy("gap")) - 1)
    own = F.struct("ord", F.lit(1).alias("after"), "id", "word", "start", "end")
    if delimiter is None:
        items = F.array(own)
    else:
        words = words.withColumn("opens", F.lag("word").over(ordered) != F.col("word"))
        between = F.struct("ord", F.lit(0).alias("after"), F.lit(delimiter).alias("id"), F.lit(-1).alias("word"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
        items = F.array_compact(F.array(F.when(F.col("opens"), between), own))
    listed = words.select(*keys, F.explode(items).alias("i")).groupBy(*keys).agg(F.array_sort(F.collect_list("i")).alias("plan"))
    return listed.select(*keys, F.transform("plan", lambda i: F.struct(*(i[c].alias(c) for c in ("id", "word", "start", "end")))).alias("plan"))


def _advance(score: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score before the next frame is added, and how many states back it comes from; of equal ones the nearest."""
    back = np.zeros(len(score), np.int8)
    best = score.copy()
    for step, allowed in ((1, slice(None)), (2, skips)):
        other = np.full(len(score), -np.inf)
        other[step:] = score[:-step] if len(score) > step else []
        other = other if step == 1 else np.where(allowed, other, -np.inf)
        back[other > best] = step
        best = np.maximum(best, other)
    return best, back


def best_path(log_probs: np.ndarray, tokens: np.ndarray, blank: int) -> np.ndarray | None:
    """Each frame's state on the most likely path through blank, first token, blank, second, ... blank; None if the tokens
    don't fit. Scores are kept at every root-th frame only, and what lies between is worked out again on the way back."""
    frames, states = len(log_probs), 2 * len(tokens) + 1
    labels = np.full(states, blank)
    labels[1::2] = tokens
    skips = np.zeros(states, bool)
    skips[3::2] = labels[3::2] != labels[1:-2:2]
    if frames < len(tokens) + int((tokens[1:] == tokens[:-1]).sum()) or not frames:
        return None
    block = max(1, int(frames**BLOCK_ROOT))
    score = np.full(states, -np.inf)
    score[:2] = log_probs[0, labels[:2]]
    kept = [score]
    for t in range(1, frames):
        score = _advance(score, skips)[0] + log_probs[t, labels]
        if t % block == 0:
            kept.append(score)
    path = np.empty(frames, np.int64)
    path[-1] = states - 1 if states == 1 or score[-1] >= score[-2] else states - 2
    for b in range(len(kept) - 1, -1, -1):
        first, last, score, backs = b * block, min(frames - 1, (b + 1) * block), kept[b], []
        for t in range(first + 1, last + 1):
            score, back = _advance(score, skips)
            score = score + log_probs[t, labels]
            backs.append(back)
        for t in range(last, first, -1):
            path[t - 1] = path[t] - backs[t - first - 1][path[t]]
    return path


def aligned_tokens(log_probs: np.ndarray, tokens: np.ndarray, blank: int) -> list[tuple[int, int, int, float]] | None:
    """token, first frame, frame after the last, mean probability."""
    path = best_path(log_probs, tokens, blank)
    if path is None:
        return None
    at = np.flatnonzero(path % 2 == 1)
    which = path[at] // 2
    n = np.bincount(which, minlength=len(tokens))
    score = np.bincount(which, np.exp(log_probs[at, tokens[which]]), len(tokens)) / n
    first = at[np.concatenate([[0], np.cumsum(n)[:-1]])] if len(tokens) else np.empty(0, int)
    return list(zip(range(len(tokens)), first.tolist(), (first + n).tolist(), score.tolist(), strict=True))


def forced_alignment(blank: int):
    """A function of (frames as an array of arrays of log probabilities, ids): token, start, end, score of each id; null if
    either is null or the ids don't fit into the frames."""

    @F.pandas_udf(TOKEN_SPANS)
    def align(emissions: pd.Series, tokens: pd.Series) -> pd.Series:
        out = []
        for frames, ids in zip(emissions, tokens):
            found = None
            if frames is not None and ids is not None and len(frames):
                found = aligned_tokens(np.stack([np.asarray(f, np.float64) for f in frames]), np.asarray(ids, np.int64), blank)
            out.append(found if found is None else [dict(zip(("token", "start", "end", "score"), s)) for s in found])
        return pd.Series(out)

    return align


def emissions_of(frames: DataFrame, keys: list[str], frame: str, probs: str) -> DataFrame:
    """Frames of a clip, a row each, as one array in order."""
    listed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(probs).alias("p")))).alias("e"))
    return listed.select(*keys, F.transform("e", lambda x: x["p"]).alias("emissions"))


def timed_groups(rows: DataFrame, keys: list[str], text: str, rate: Column) -> DataFrame:
    """``keys``, groups, coverage, confidence and status of texts whose ids are aligned. ``rows``: keys, text, plan and spans. Groups cover the text in
    order; words that share characters are one; what lies between timed words is an untimed group. Texts that didn't fit have no groups and the status failed."""
    base = rows.select(*keys, F.col(text).alias("text"), "plan", "spans", rate.alias("rate"))
    tokens = base.select(*keys, "rate", F.explode(F.zip_with("plan", "spans", lambda p, s: F.struct(p.alias("p"), s.alias("s")))).alias("t"))
    tokens = tokens.where("t.p.word >= 0 and t.s is not null").groupBy(*keys, F.col("t.p.word").alias("word")).agg(
        F.min("t.p.start").alias("char_start"), F.max("t.p.end").alias("char_end"), F.min(F.col("t.s.start") / F.col("rate")).alias("start"),
        F.max(F.col("t.s.end") / F.col("rate")).alias("end"), F.avg("t.s.score").alias("confidence"),
    )
    words = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "start", "end", "confidence"))).alias("words"))
    merged = base.select(*keys, "text").join(words.select(*keys, A.merged_overlaps(F.col("words")).alias("words")), keys, "left")
    nothing = F.array().cast("array<struct<char_start:int,char_end:int,start:double,end:double,confidence:double>>")
    merged = merged.withColumn("words", F.coalesce("words", nothing))
    whole = A.covering_groups(F.col("text"), F.col("words"))
    timed = F.array_join(F.transform("words", lambda w: F.substr(F.col("text"), w["char_start"] + 1, w["char_end"] - w["char_start"])), "")
    coverage = F.coalesce(letter_coverage(timed, F.col("text")), F.lit(0.0))
    confidence = F.when(F.size("words") > 0, F.aggregate("words", F.lit(0.0), lambda s, w: s + w["confidence"]) / F.size("words")).otherwise(0.0)
    out = merged.select(*keys, whole.alias("groups"), coverage.alias("coverage"), confidence.alias("confidence"))
    return out.withColumn("status", F.when(F.size(F.filter("groups", lambda g: g["start"].isNotNull())) == 0, "failed").otherwise(alignment_status(F.col("coverage"), F.col("confidence"))))
