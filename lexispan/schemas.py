"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()  # noqa: E741


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVENTS = T.ArrayType(struct(tStartMs=D, dDurationMs=D, segs=T.ArrayType(struct(utf8=S, tOffsetMs=D))))
CAPTIONS = struct(events=EVENTS)
METADATA = struct(
    cache_schema_version=I, catalogue_schema_version=I, catalogue_id=S, source_language=S, video_key=S, track_id=S, video_id=S,
    provider=S, url=S, title=S, channel_id=S, channel=S, channel_config_id=S, duration=D, playable_in_embed=B, upload_date=S, thumbnail=S,
    varieties=T.ArrayType(S), speech_style=T.ArrayType(S), caption_kind=S, caption_language=S, content_sha256=S,
)
MANIFEST = struct(
    manifest_schema_version=I, provider=S, video_key=S, video_id=S, source_language=S, canonical_source_track_id=S, complete=B,
    tracks=T.ArrayType(struct(track_id=S, language=S, kind=S, is_source=B, is_translatable=B, status=S, content_sha256=S)),
)
CATALOGUE = struct(
    schema_version=I, language=S, description=S,
    sections=T.ArrayType(struct(id=S, name=S, description=S, channels=T.ArrayType(
        struct(id=S, name=S, url=S, enabled=B, varieties=T.ArrayType(S), speech_style=T.ArrayType(S), description=S)
    ))),
)
WORDS = T.ArrayType(
    struct(id=S, form=S, lemma=S, upos=S, features=S, start=I, end=I, shared_span=B)
)
