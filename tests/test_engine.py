"""End to end: caption folders to an index, phrase queries, suggestions, statistics."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexispan.engine import Engine
from lexispan.functions import text as X
from lexispan.operators.search import SearchError
from lexispan.sources import captions, index_store

LINES = {"v1": ["Sí, la verdad es una buena idea.", "La verdad funciona muy bien."], "v2": ["Sí, la verdad es una buena idea.", "La verdad funciona muy bien."],
         "v3": ["Una casa bonita y grande.", "Casas muy bonitas aquí.", "Veo casas bonitas hoy."]}


def write(root, video, lines, **more):
    folder = root / "es" / video / f"t-{video}"
    folder.mkdir(parents=True)
    events = [{"tStartMs": 1000 + 3000 * k, "dDurationMs": 2500, "segs": [{"utf8": x}]} for k, x in enumerate(lines)]
    payload = json.dumps({"events": events}).encode()
    (folder / "captions.json3").write_bytes(payload)
    meta = {"source_language": "es", "video_key": video, "track_id": f"t-{video}", "video_id": video, "channel": "c", "channel_config_id": f"ch-{video}",
            "title": video, "duration": 60.0, "caption_kind": "manual", "content_sha256": hashlib.sha256(payload).hexdigest()}
    (folder / "metadata.json").write_text(json.dumps(meta | more))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    for video, lines in LINES.items():
        write(raw, video, lines, **({"playable_in_embed": False} if video == "v2" else {}))
    lexicon = spark.createDataFrame([("es", "casas", "casa"), ("es", "casa", "casa"), ("es", "bonitas", "bonito"), ("es", "bonita", "bonito")], "language string, normalized string, lemma string")
    own = Engine(spark, str(tmp_path_factory.mktemp("index")))
    own.build(str(raw), "b1", lexicon)
    return own


def test_exact_phrase_counts_all_but_shows_only_playable(engine):
    found = engine.search("la verdad", "es")
    assert found.totals.first()["exact"] == 4
    hits = found.hits.orderBy("rank").collect()
    assert [h["video_key"] for h in hits] == ["v1", "v1"]
    assert {h["matched"].lower() for h in hits} == {"la verdad"}


def test_lemma_route_needs_contiguity(engine):
    found = engine.search("casa bonita", "es")
    t = found.totals.first()
    assert (t["exact"], t["lemma"], t["auto"]) == (1, 2, 2)
    assert [h["in_exact"] for h in found.hits.orderBy("rank").collect()] == [1, 0]


def test_accents_are_tolerated_and_preferred(engine):
    plain, accented = engine.search("si", "es").hits.first(), engine.search("sí", "es").hits.first()
    assert plain["segment_id"] == accented["segment_id"]
    assert (plain["accent_exact"], accented["accent_exact"]) == (False, True)
    assert accented["score"] > plain["score"]


def test_seeded_order_repeats(engine):
    pages = [[h["occurrence_id"] for h in engine.search("la verdad", "es", order="random", seed="9").hits.collect()] for _ in range(2)]
    assert pages[0] == pages[1] and pages[0]


def test_index_and_queries_fold_alike_in_all_scripts(spark, tmp_path):
    lines = ["Tiếng Việt rất hay.", "Ёлка и йод здесь.", "Άλφα και ς.", "ﬁn du jour.", "हिन्दी भाषा है.", "cafe\u0301 noir."]
    write(tmp_path / "raw", "w", lines)
    own = Engine(spark, str(tmp_path / "index"))
    own.build(str(tmp_path / "raw"), "b")
    for query in ("việt", "ёлка", "йод", "Άλφα", "fin", "ﬁn", "हिन्दी", "café", "cafe noir"):
        assert own.search(query, "es").totals.first()["exact"] == 1, query


def test_accent_key_ignores_punctuation(engine):
    assert engine.search("sí, la", "es").hits.first()["accent_exact"]


def test_build_reads_the_track_that_a_manifest_names(spark, tmp_path):
    write(tmp_path / "raw", "v", ["Hola amigos."])
    write(tmp_path / "raw", "u", ["Hola de nuevo."])
    manifests = spark.createDataFrame([("v", "t-other"), ("u", "t-u")], "video_key string, canonical_source_track_id string")
    own = Engine(spark, str(tmp_path / "index"))
    own.build(str(tmp_path / "raw"), "b", manifests=manifests)
    assert [r["video_key"] for r in own.table("segments").collect()] == ["u"]


TABLES = ("segments", "stream_tokens", "ngrams_by_video", "ngram_stats", "span_counts", "form_lexicon")


def rows_of(own, name):
    df = own.table(name)
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_updates_equal_a_new_build(spark, tmp_path):
    """Videos replaced, added and taken out, twice: every table is what a build of the final tracks gives."""
    lexicon = spark.createDataFrame([("es", w, w.rstrip("s")) for w in ("casas", "casa", "bonitas", "bonita", "ideas", "idea")], "language string, normalized string, lemma string")
    steps = [
        {"v1": ["Sí, la verdad es una buena idea.", "LA verdad."], "v2": ["Casas bonitas.", "la verdad"], "v3": ["Una casa bonita y grande."], "v4": ["Adiós ideas."]},
        {"v1": ["Ya no es la idea de antes.", "la verdad"], "v5": ["Casa, casa y casas."]},
        {"v5": ["Otra idea."], "v3": ["Una CASA más grande."]},
    ]
    removed = [None, ["v4"], ["v2", "unknown"]]
    own, final = Engine(spark, str(tmp_path / "index")), {}
    for k, (step, gone) in enumerate(zip(steps, removed)):
        final = {v: lines for v, lines in {**final, **step}.items() if v not in (gone or [])}
        for video, lines in step.items():
            write(tmp_path / f"raw{k}", video, lines)
        if not k:
            own.build(str(tmp_path / "raw0"), "b0", lexicon)
            continue
        tracks = captions.checked(captions.scan(spark, str(tmp_path / f"raw{k}")))
        own.update(tracks, f"b{k}", lexicon, spark.createDataFrame([(v,) for v in gone], "video_key string"))
        for video, lines in final.items():
            write(tmp_path / f"whole{k}", video, lines)
        whole = Engine(spark, str(tmp_path / f"new{k}"))
        whole.build(str(tmp_path / f"whole{k}"), "b", lexicon)
        for name in TABLES:
            assert rows_of(own, name) == rows_of(whole, name), (k, name)
    assert index_store.live_parts(spark, own.root) == ["b0", "b1", "b2"]
    assert own.search("la verdad", "es").totals.first()["exact"] == 1
    assert own.search("casa", "es", mode="lemma").totals.first()["lemma"] == 1


def test_all_that_is_published_folds_alike(spark, tmp_path):
    """Korean, Japanese and Arabic forms: every n-gram and lemma is a key of the token streams."""
    lines = ["한국어 문장이 있다.", "ｶﾀｶﾅ と ﾊﾝｶｸ です。", "ﻻ إله العربيةُ.", "ﬁn Ｗｉｄｅ １２."]
    write(tmp_path / "raw", "w", lines)
    lexicon = spark.createDataFrame([("es", X.normal_token("한국어"), "한국"), ("es", X.normal_token("ﬁn"), "ﬁ")], "language string, normalized string, lemma string")
    own = Engine(spark, str(tmp_path / "index"))
    own.build(str(tmp_path / "raw"), "b", lexicon)
    streams = {(r["kind"], r["tok"]) for r in own.table("stream_tokens").collect()}
    exact = {t for k, t in streams if k == "exact"}
    grams = {r["normalized"] for r in own.table("ngram_stats").where("n = 1").collect()}
    assert grams == exact and len(exact) >= 11
    assert {X.normal_token("한국"), "fi"} <= {t for k, t in streams if k == "lemma"}
    assert own.search("한국", "es", mode="lemma").totals.first()["lemma"] == 1
    for word in ("문장이", "カタカナ", "です", "لا", "العربية", "fin", "wide 12"):
        assert own.search(word, "es").totals.first()["exact"] == 1, word
    for code, words in X.FUNCTION_WORDS.items():
        assert {X.normal_token(w) for w in words.split()} == set(X.STOPWORDS[code])
    hangul = X.normal_token("은")
    assert spark.range(1).select(X.is_stopword(F.lit("ko"), X.normal_token_udf(F.lit("은"))).alias("x")).first()["x"] and len(hangul) > 1


def test_lemma_mode_needs_lemmas(spark, tmp_path):
    write(tmp_path / "raw", "w", ["Hola amigos."])
    own = Engine(spark, str(tmp_path / "index"))
    own.build(str(tmp_path / "raw"), "b")
    assert own.search("hola", "es").totals.first()["auto"] == 1
    with pytest.raises(SearchError, match="lemmas"):
        own.search("hola", "es", mode="lemma")


def test_invalid_queries(engine):
    for bad in ({"query": "  "}, {"query": "x", "seed": "5"}, {"query": "a b c d e f"}, {"query": "x", "mode": "fuzzy"}, {"query": "x", "limit": 51}, {"query": "x", "order": "random"}):
        with pytest.raises(SearchError):
            engine.search(language="es", **bad)
    with pytest.raises(SearchError):
        engine.search("x", "de")


def test_suggestions_leave_out_stop_words(engine):
    words = [r["normalized"] for r in engine.suggestions("es", 10).collect()]
    assert "verdad" in words and "la" not in words


def test_statistics_roll_up(engine):
    total = engine.statistics().where("level = 3").first()
    assert (total["videos"], total["segments"]) == (3, 7)


def test_spans_per_segment(engine):
    row = engine.table("span_counts").join(engine.table("segments"), "segment_id").where("text = 'Veo casas bonitas hoy.'").first()
    assert row["n_spans"] == 4 + 3 + 2 + 1


def test_rebuild_moves_the_pointer_and_a_failed_one_does_not(spark, tmp_path):
    one = spark.range(3)
    index_store.publish({"x": one}, str(tmp_path), "a")
    bad = one.selectExpr("raise_error('no') as id")
    with pytest.raises(Exception):
        index_store.publish({"x": bad}, str(tmp_path), "b")
    assert index_store.opened(spark, str(tmp_path), "x").count() == 3
    with pytest.raises(index_store.IndexUnavailable):
        index_store.current(spark, str(tmp_path / "none"))


def test_scan_finds_what_is_wrong(spark, tmp_path):
    write(tmp_path, "ok", ["Hola."])
    write(tmp_path, "sum", ["Hola."], content_sha256="0")
    write(tmp_path, "moved", ["Hola."], video_key="elsewhere")
    found = {r["track_id"]: r["problem"] for r in captions.scan(spark, str(tmp_path)).collect()}
    assert found == {"t-ok": None, "t-sum": "checksum differs", "t-moved": "metadata and path differ"}
    with pytest.raises(Exception, match="differ"):
        captions.checked(captions.scan(spark, str(tmp_path))).collect()
