"""Content-addressed keys: a prefix and twenty hexadecimal digits of the SHA-256 of the parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between; a null part counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    joined = texts[0]
    for t in texts[1:]:
        joined = F.concat(joined, F.lit("\0"), t)
    return F.sha2(joined, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.left(digest(*parts), F.lit(20)))


def video_key(provider: Column, language: Column, video_id: Column) -> Column:
    return stable_id("vid", provider, language, video_id)


def track_id(video: Column, kind: Column, language: Column) -> Column:
    return stable_id("trk", video, kind, language)


def segment_id(video_id: Column, language: Column, track: Column, start: Column, end: Column, text: Column) -> Column:
    seconds = lambda x: F.format_string("%.3f", x)
    return stable_id("seg", video_id, language, track, seconds(start), seconds(end), F.sha2(text, 256))


def clip_id(source_sha: Column, start_ms: Column, end_ms: Column, padding_ms: Column, from_ms: Column, to_ms: Column, version: Column) -> Column:
    return stable_id("clp", source_sha, start_ms, end_ms, padding_ms, from_ms, to_ms, version)


def alignment_id(text: Column, language: Column, clip_sha: Column, aligner: Column, model: Column, settings: Column) -> Column:
    return stable_id("aln", F.sha2(text, 256), language, clip_sha, aligner, model, settings)


def occurrence_id(segment: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", segment, start.cast("string"), end.cast("string"))


def hash_order(seed: str, ident: Column) -> Column:
    """A seeded order: by the SHA-256 of seed and id."""
    return F.sha2(F.concat_ws(":", F.lit(seed), ident.cast("string")), 256)
