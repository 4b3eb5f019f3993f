"""The library's face: build an index from caption tracks, search it, ask for suggestions and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions import ids
from lexispan.functions import text as X
from lexispan.operators import search as S
from lexispan.operators import segmenting as G
from lexispan.operators import tokens as K
from lexispan.sources import captions, index_store
from lexispan.sources.scratch import written

MAX_NGRAM = 5


def built(tracks: DataFrame, lexicon: DataFrame | None = None, max_ngram: int = MAX_NGRAM) -> dict[str, DataFrame]:
    """Index tables of caption tracks (see ``captions.scan``). ``lexicon``: language, normalized, lemma; without it there is
    no lemma route."""
    videos = tracks.select("track_id", "video_key", "video_id", "source_language", "channel", "title", "duration", "playable_in_embed", "caption_kind").dropDuplicates(["track_id"])
    units = G.units_of_cues(tracks.select(F.col("track_id").alias("track"), F.col("caption_kind").alias("kind"), "events"))
    joined = G.segmented(units).join(videos, F.col("track") == F.col("track_id"))
    done = G.finished(joined, F.col("caption_kind") == "manual", F.col("duration"))
    segments = done.withColumn("segment_id", ids.segment_id(F.col("video_id"), F.col("source_language"), F.col("track_id"), F.col("start"), F.col("end"), F.col("text")))
    located = segments.select("source_language", "video_key", "segment_id", X.tokens_with_spans("text").alias("located"))
    arrays = [F.col(f"located.{c}").alias(n) for c, n in (("tok", "norm"), ("surface", "surf"))]
    grams = K.grams_by_video(located.select(F.col("source_language").alias("language"), F.col("video_key").alias("video"), *arrays), min(3, max_ngram))
    spans = located.select("source_language", "video_key", "segment_id", F.posexplode("located").alias("pos", "t"))
    spans = spans.select(
        "source_language", "video_key", "segment_id", "pos", F.col("t.tok").alias("tok"), "t.surface",
        F.col("t.start").alias("char_start"), F.col("t.end").alias("char_end"),
    )
    exact = spans.withColumn("kind", F.lit("exact"))
    streams, lexicon_rows = exact, None
    if lexicon is not None:
        known = lexicon.select(F.col("language").alias("source_language"), F.col("normalized").alias("tok"), X.usable_lemma(F.col("lemma")).alias("lemma")).where("lemma is not null")
        lemmas = spans.join(known, ["source_language", "tok"])
        lexicon_rows = K.form_lexicon(_lexicon_tokens(lemmas), "source_language")
        # positions stay those of the text: a token without a lemma leaves a hole that phrases can't cross
        streams = exact.unionByName(lemmas.select(*[F.col("lemma").alias("tok") if c == "tok" else c for c in spans.columns], F.lit("lemma").alias("kind")))
    counts = exact.groupBy("segment_id").agg(F.count(F.lit(1)).alias("token_count"))
    tables = {
        "segments": segments.drop("track", "n_tokens").join(counts, "segment_id", "left"),
        "stream_tokens": streams,
        "ngrams_by_video": grams.withColumnRenamed("video", "video_key"),
        "ngram_stats": K.gram_totals(grams),
        "span_counts": K.distinct_spans(exact.withColumn("stream", F.col("kind")), ["source_language", "video_key", "segment_id"], max_ngram),
    }
    if lexicon_rows is not None:
        tables["form_lexicon"] = lexicon_rows
    return tables


def _lexicon_tokens(lemmas: DataFrame) -> DataFrame:
    return lemmas.select("source_language", F.col("tok").alias("normalized"), "lemma", F.lit(None).cast("string").alias("upos"))


def _paired(tokens: DataFrame) -> DataFrame:
    """Surfaces beside the lemmas at their place, from published streams."""
    place = ["source_language", "segment_id", "pos"]
    exact, lemma = tokens.where("kind = 'exact'").select(*place, "tok"), tokens.where("kind = 'lemma'").select(*place, F.col("tok").alias("lemma"))
    return exact.join(lemma, place)


@dataclass
class Found:
    hits: DataFrame
    totals: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def build(self, raw_root: str, build: str, lexicon: DataFrame | None = None, channels: DataFrame | None = None, manifests: DataFrame | None = None) -> str:
        """Indexes the tracks under ``raw_root``: of enabled channels (see ``captions.channels``), and of videos with a manifest
        (video_key, canonical_source_track_id) only the track that it names."""
        tracks = captions.checked(captions.scan(self.spark, raw_root))
        if channels is not None:
            tracks = captions.without_disabled(tracks, channels)
        if manifests is not None:
            tracks = captions.canonical(tracks, manifests)
        return index_store.publish(built(tracks, lexicon), self.root, build)

    def update(self, tracks: DataFrame, build: str, lexicon: DataFrame | None = None, removed: DataFrame | None = None) -> str:
        """Publishes the index with the videos of ``tracks`` replaced by these tracks, and those of ``removed`` (video_key) taken out. Only the new
        tracks are analysed: they become a part of their own, and counts move by what these videos had and have."""
        new = {name: written(df, f"update-{name}") for name, df in built(tracks, lexicon).items() if name not in ("ngram_stats", "form_lexicon")}
        replaced = tracks.select("video_key").distinct()
        replaced = written(replaced if removed is None else replaced.union(removed.select("video_key")).distinct(), "update-replaced")
        before = {name: self.table(name) for name in ("ngram_stats", "ngrams_by_video", "stream_tokens")}
        old_grams = before["ngrams_by_video"].join(replaced, "video_key", "left_semi")
        grams = [df.drop("video_key") for df in (old_grams, new["ngrams_by_video"])]
        live = before["ngrams_by_video"].join(replaced, "video_key", "left_anti").unionByName(new["ngrams_by_video"])
        tables = {**new, index_store.REPLACED: replaced, "ngram_stats": K.moved_totals(before["ngram_stats"], *grams, live)}
        known = self._lexicon()
        if known is not None:
            old = _paired(before["stream_tokens"].join(replaced, "video_key", "left_semi"))
            tables["form_lexicon"] = K.moved_lexicon(known, _lexicon_tokens(old), _lexicon_tokens(_paired(new["stream_tokens"])), "source_language")
        return index_store.publish(tables, self.root, build, index_store.live_parts(self.spark, self.root))

    def table(self, name: str) -> DataFrame:
        return index_store.opened(self.spark, self.root, name)

    def search(self, query: str, language: str, mode: str = "auto", order: str = "ranked", limit: int = 20, seed: str | None = None) -> Found:
        """The page of hits, best first or in seeded order, and totals by mode before anything is dropped."""
        surfaces = [s for s, _, _ in X.spans_of(query)]
        words = [X.normal_token(s) for s in surfaces]
        S.validated(query, words, mode, order, limit, seed)
        tokens = self.table("stream_tokens").where(F.col("source_language") == language)
        segments = self.table("segments").where(F.col("source_language") == language)
        if segments.isEmpty():
            raise S.SearchError(f"language {language} isn't indexed")
        if mode == "lemma" and tokens.where("kind = 'lemma'").isEmpty():
            raise S.SearchError(f"the index has no lemmas for {language}")
        n = len(words)
        exact = K.phrase_matches(tokens.where("kind = 'exact'"), ["segment_id"], [[w] for w in words])
        sets = self._candidates(language, words)
        lemma = K.phrase_matches(tokens.where("kind = 'lemma'"), ["segment_id"], sets) if all(sets) else exact.limit(0)
        occurrences = S.merged(exact, lemma, ["segment_id", "pos"])
        asked = {"auto": F.lit(True), "exact": F.col("in_exact") == 1, "lemma": F.col("in_lemma") == 1}[mode]
        seeds = tokens.where("kind = 'exact'")
        first = seeds.select("segment_id", "pos", "char_start")
        last = seeds.select("segment_id", (F.col("pos") - (n - 1)).alias("pos"), "char_end")
        wide = occurrences.where(asked).join(first, ["segment_id", "pos"]).join(last, ["segment_id", "pos"])
        playable = segments.where(F.coalesce("playable_in_embed", F.lit(True)))
        rows = wide.join(playable.select("segment_id", "video_key", "clip_start", "quality", "token_count", "text"), "segment_id")
        matched = F.expr("substring(text, char_start + 1, char_end - char_start)")
        rows = rows.withColumn("matched", matched).withColumn("accent_exact", X.accent_key(F.col("matched")) == F.lit(X.accent_key_text(query)))
        scored = S.scored(rows, n).withColumn("occurrence_id", ids.occurrence_id(F.col("segment_id"), F.col("char_start"), F.col("char_end")))
        keys = [F.desc("score"), "video_key", "clip_start", "char_start", "occurrence_id"]
        best = S.best_of_segment(scored.drop("text"), ["segment_id"], [F.desc("in_exact"), *keys])
        if order == "random":
            page = S.random_page(best, "occurrence_id", seed, limit)
        else:
            page = S.diversified(best.withColumn("tier", 1 - F.col("in_exact")), "tier", "video_key", keys, limit)
        # the rest of a segment's columns is looked up for the page only
        own = [c for c in segments.columns if c not in page.columns or c == "segment_id"]
        return Found(segments.select(*own).join(F.broadcast(page), "segment_id"), S.totals(occurrences))

    def _candidates(self, language: str, words: list[str]) -> list[list[str]]:
        """Lemmas that the corpus has seen for each query word, and the word itself where it is a lemma: a lookup of a few rows."""
        known = self._lexicon()
        if known is None:
            return [[] for _ in words]
        lexicon = known.where(F.col("source_language") == language)
        met = lexicon.where(F.col("normalized").isin(*words) | F.col("lemma").isin(*words)).select("normalized", "lemma").distinct().collect()
        return [sorted({r["lemma"] for r in met if r["normalized"] == w or r["lemma"] == w}) for w in words]

    def _lexicon(self) -> DataFrame | None:
        """The published form lexicon, if the index was built with one."""
        try:
            return self.table("form_lexicon")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def suggestions(self, language: str, limit: int = 20) -> DataFrame:
        stats = self.table("ngram_stats").where(F.col("language") == language)
        return S.suggestions(stats, lambda t: X.is_stopword(F.lit(language), t), limit)

    def statistics(self) -> DataFrame:
        """Videos, segments and tokens by language and channel, with subtotals."""
        return self.table("segments").rollup("source_language", "channel").agg(
            F.count_distinct("video_key").alias("videos"), F.count_distinct("segment_id").alias("segments"), F.sum("token_count").alias("tokens"), F.grouping_id().alias("level")
        )

    def clip(self, segment_id: str) -> DataFrame:
        return self.table("segments").where(F.col("segment_id") == segment_id)


__all__ = ["Engine", "Found", "built"]
