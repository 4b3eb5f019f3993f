"""Scores and measures of segments, clips, alignments and recognised text, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How sure a boundary is, by the reason for it.
BOUNDARY_CONFIDENCE = {"punctuation": 1.0, "pause": 0.78, "end": 0.68, "forced": 0.38}
PAD_BEFORE, PAD_AFTER, LEAST_CLIP = 0.35, 0.65, 0.1


def boundary_confidence(reason: Column) -> Column:
    out = F.lit(0.5)
    for name, value in BOUNDARY_CONFIDENCE.items():
        out = F.when(reason == name, value).otherwise(out)
    return out


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def segment_quality(confidence: Column, duration: Column, n_tokens: Column, manual: Column) -> Column:
    """0.4 boundary + 0.25 duration + 0.2 length + 0.15 source, to four places."""
    lasting = F.when(duration.between(2, 12), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(duration - 7) / 12))
    long = F.when(n_tokens.between(5, 25), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n_tokens - 15) / 24))
    source = F.when(manual, 1.0).otherwise(0.65)
    return round4(0.4 * confidence + 0.25 * lasting + 0.2 * long + 0.15 * source)


def clip_start(start: Column) -> Column:
    return F.greatest(F.lit(0.0), start - PAD_BEFORE)


def clip_end(start: Column, end: Column, duration: Column) -> Column:
    """The padded end, within the recording if its length is known (null and 0 are not), and a tenth of a second behind the clip's start at least."""
    padded = F.when(duration > 0, F.least(end + PAD_AFTER, duration)).otherwise(end + PAD_AFTER)
    return F.greatest(padded, clip_start(start) + LEAST_CLIP)


def match_score(quality: Column, accent_exact: Column, token_start: Column, n: Column, token_count: Column) -> Column:
    """Quality first, then equal accents, then a place near the middle of the segment; 0.99 at most, to four places."""
    centre = (token_start + n / 2) / F.greatest(token_count, F.lit(1))
    middle = F.greatest(F.lit(0.0), 1 - F.abs(0.5 - centre) * 2)
    return F.least(F.lit(0.99), round4(0.9 * quality + 0.04 * accent_exact.cast("int") + 0.03 * middle))


def clip_range_ms(start_ms: Column, end_ms: Column, padding_ms: Column, duration_ms: Column) -> tuple[Column, Column]:
    """A padded clip clamped to its recording, in whole milliseconds."""
    return F.greatest(F.lit(0), start_ms - padding_ms), F.least(duration_ms, end_ms + padding_ms)


def speaking_rates(n_tokens: Column, clip_s: Column, voiced_s: Column) -> Column:
    """status, tokens a clip second, tokens a voiced second (null without voice)."""
    ok = clip_s > 0
    return F.struct(
        F.when(ok, "complete").otherwise("failed").alias("status"),
        F.when(ok, n_tokens / clip_s).alias("per_second"),
        F.when(ok & (voiced_s > 0), n_tokens / voiced_s).alias("per_voiced_second"),
    )


def speech_ratio(voiced_s: Column, duration_s: Column) -> Column:
    return F.when(duration_s > 0, F.least(F.lit(1.0), voiced_s / duration_s))


def error_rate(substituted: Column, deleted: Column, inserted: Column, n_reference: Column) -> Column:
    """Errors over reference length; 0 if both are empty, null if only the reference is."""
    errors = substituted + deleted + inserted
    return F.when(n_reference > 0, errors / n_reference).when(errors == 0, 0.0)


def agreement(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - rate)


def letter_coverage(covered: Column, text: Column) -> Column:
    """Share of a text's letters and digits that a covered part has."""
    bare = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return bare(covered) / F.when(bare(text) > 0, bare(text))


def alignment_status(coverage: Column, confidence: Column) -> Column:
    return F.when(confidence < 0.10, "failed").when(coverage >= 0.95, "complete").otherwise("partial")


def ratio(top: Column, bottom: Column) -> Column:
    """Null where there is nothing to divide by."""
    return top / F.when(bottom != 0, bottom)


# Language codes that stand for another.
LANGUAGE_ALIASES = {"zh-cn": "zh", "zh-hans": "zh", "zh-tw": "zh", "yue": "zh", "cmn": "zh", "pt-br": "pt", "pt-pt": "pt"}


def bare_language(code: Column) -> Column:
    """The language of a detector's label: ``es: Spanish`` and ``es_MX`` are ``es``."""
    tag = F.replace(F.lower(F.trim(F.substring_index(code, ":", 1))), F.lit("_"), F.lit("-"))
    aliases = F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, tag), F.substring_index(tag, "-", 1))


def probability_of(distribution: Column, language: Column) -> Column:
    """Mass of all labels of a language, from an array of (code, p)."""
    own = F.filter(distribution, lambda e: bare_language(e["code"]) == bare_language(language))
    return F.aggregate(own, F.lit(0.0), lambda a, e: a + e["p"])


def closed_set_probability(distribution: Column, language: Column, languages: list[str]) -> Column:
    """A language's share of the mass of the languages that the corpus can have; null without mass."""
    known = F.array_distinct(F.array(*(bare_language(F.lit(c)) for c in languages)))
    kept = F.filter(distribution, lambda e: F.array_contains(known, bare_language(e["code"])))
    every = F.aggregate(kept, F.lit(0.0), lambda a, e: a + e["p"])
    return ratio(probability_of(distribution, language), F.when(every > 0, every))


def pairwise_probability(top: Column, p: Column, language: Column) -> Column:
    """``p`` of a language against its strongest rival among ``top``, an array of (code, p); null without ``p`` or without mass."""
    rivals = F.transform(F.filter(top, lambda e: bare_language(e["code"]) != bare_language(language)), lambda e: e["p"])
    best = F.coalesce(F.array_max(rivals), F.lit(0.0))
    return F.when(p + best > 0, p / (p + best))
