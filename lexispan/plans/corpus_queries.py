"""Queries over the positional index: tokens, phrases, n-grams, search, suggestions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispan.functions import ids
from lexispan.functions import measures as M
from lexispan.functions import text as X
from lexispan.operators import gram_counts as GC
from lexispan.operators import sampling as SA
from lexispan.operators import search as S
from lexispan.operators import tokens as K
from lexispan.plans.tables import SQL_SEGMENTS, SQL_STREAM, query, sql_tokens, table

SEG = ["doc_id", "seg"]


def _segments(spark, d):
    return K.segments(table(spark, d, "documents"))


def _stream(spark, d):
    return K.stream(_segments(spark, d), ["doc_id", "lang", "source", "seg"])


@query(f"""WITH {SQL_STREAM} SELECT lang, count(*) AS n_tokens, count(DISTINCT tok) AS n_types, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY lang""")
def token_counts_by_lang(spark, d):
    """From the published index: its counts of words, and documents with tokens."""
    from lexispan.plans.index_queries import opened

    words = opened(spark, d, "word_counts").groupBy(F.col("language").alias("lang")).agg(F.sum("total_count").alias("n_tokens"), F.count(F.lit(1)).alias("n_types"))
    docs = opened(spark, d, "segments").where("token_count > 0").select(F.col("source_language").alias("lang"), "video_key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return words.join(docs, "lang")


@query(f"""WITH {SQL_STREAM}, c AS (SELECT lang, tok, count(*) AS n FROM tok GROUP BY lang, tok)
SELECT lang, tok, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rank FROM c) WHERE rank <= 25""")
def top_terms(spark, d):
    counts = _stream(spark, d).groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("lang").orderBy(F.desc("n"), "tok")
    return counts.withColumn("rank", F.row_number().over(over)).where("rank <= 25")


@query(f"""WITH {SQL_STREAM} SELECT a.lang, count(*) AS hits, count(DISTINCT a.doc_id) AS n_docs FROM tok a
JOIN tok b ON a.doc_id = b.doc_id AND a.seg = b.seg AND b.pos = a.pos + 1 WHERE a.tok = 'of' AND b.tok = 'the' GROUP BY a.lang""")
def phrase_exact_of_the(spark, d):
    """From the published index: positions of two words, joined; the filters on them reach the files."""
    from lexispan.plans.index_queries import opened

    hits = K.phrase_matches(opened(spark, d, "stream_tokens").withColumnRenamed("source_language", "lang"), ["lang", "video_key", "segment_id"], [["of"], ["the"]])
    return hits.groupBy("lang").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("video_key").alias("n_docs"))


@query(f"""WITH {SQL_STREAM} SELECT a.doc_id, a.seg, a.pos, concat_ws(' ', a.tok, b.tok, c.tok) AS surface FROM tok a
JOIN tok b ON a.doc_id = b.doc_id AND a.seg = b.seg AND b.pos = a.pos + 1 JOIN tok c ON a.doc_id = c.doc_id AND a.seg = c.seg AND c.pos = a.pos + 2
WHERE a.tok IN ('the', 'a', 'an') AND b.tok IN ('of', 'and', 'to') AND c.tok IN ('the', 'that', 'a')""")
def phrase_set_candidates(spark, d):
    sets = [["the", "a", "an"], ["of", "and", "to"], ["the", "that", "a"]]
    return K.phrase_hits(_segments(spark, d), SEG, sets)


@query(f"""WITH {SQL_STREAM}, n AS (SELECT doc_id, seg, tok AS t0, lead(tok, 1) OVER w AS t1, lead(tok, 2) OVER w AS t2 FROM tok WINDOW w AS (PARTITION BY doc_id, seg ORDER BY pos))
SELECT phrase, count(*) AS hits, count(DISTINCT doc_id) AS n_docs FROM (
 SELECT doc_id, 'of the' AS phrase FROM n WHERE t0 = 'of' AND t1 = 'the' UNION ALL SELECT doc_id, 'and the' FROM n WHERE t0 = 'and' AND t1 = 'the'
 UNION ALL SELECT doc_id, 'de la' FROM n WHERE t0 = 'de' AND t1 = 'la' UNION ALL SELECT doc_id, 'the of the' FROM n WHERE t0 = 'the' AND t1 = 'of' AND t2 = 'the'
 UNION ALL SELECT doc_id, 'und' FROM n WHERE t0 = 'und') GROUP BY phrase""")
def phrase_batch_windowed(spark, d):
    phrases = {p: p.split() for p in ("of the", "and the", "de la", "the of the", "und")}
    hits = K.phrase_batch_hits(_segments(spark, d), SEG, phrases)
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH {SQL_STREAM}, b AS (SELECT item_id, {sql_tokens('text')} AS toks FROM benchmark),
q AS (SELECT item_id, k, toks[k] AS t0, toks[k + 1] AS t1, toks[k + 2] AS t2 FROM (SELECT item_id, toks, unnest(range(1, len(toks) - 1)) AS k FROM b)),
n AS (SELECT doc_id, tok AS t0, lead(tok, 1) OVER w AS t1, lead(tok, 2) OVER w AS t2 FROM tok WINDOW w AS (PARTITION BY doc_id, seg ORDER BY pos))
SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS n_docs FROM (SELECT DISTINCT item_id, t0, t1, t2 FROM q) JOIN n USING (t0, t1, t2) GROUP BY item_id""")
def phrase_trigram_hits(spark, d):
    """All trigrams of the benchmark items against all segments: both sides are cut to trigrams in their rows."""
    listed = lambda rows, keys: rows.select(*keys, X.normalized_tokens(F.col("text")).alias("toks"))
    grams = lambda rows, keys: listed(rows, keys).select(*keys, F.explode(K.ngrams(F.col("toks"), 3)).alias("gram"))
    wanted = grams(table(spark, d, "benchmark"), ["item_id"]).distinct()
    return grams(_segments(spark, d), ["doc_id"]).join(wanted, "gram").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("n_docs")
    )


@query(f"""WITH {SQL_STREAM} SELECT doc_id FROM tok WHERE tok IN ('the', 'and', 'with', 'this', 'for') GROUP BY doc_id HAVING count(DISTINCT tok) = 5""")
def relational_division_docs(spark, d):
    return K.containing_all(_stream(spark, d), ["doc_id"], ["the", "and", "with", "this", "for"])


_SQL_NGRAMS = " UNION ALL ".join(
    f"""SELECT lang AS language, doc_id, array_to_string(toks[k:k+{n - 1}], ' ') AS normalized, {n} AS n, array_to_string(surf[k:k+{n - 1}], ' ') AS surface
  FROM (SELECT *, unnest(range(1, len(toks) - {n} + 2)) AS k FROM both_forms)"""
    for n in (1, 2, 3)
)


_SQL_STATS = rf"""{SQL_SEGMENTS}, surfs AS (SELECT doc_id, lang, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS surf FROM segs),
both_forms AS (SELECT doc_id, lang, surf, list_transform(surf, lambda s: FOLDED) AS toks FROM surfs),
stats AS (SELECT language, normalized, n, min(surface) AS surface, count(*) AS total_count, count(DISTINCT doc_id) AS video_count FROM ({_SQL_NGRAMS}) GROUP BY language, normalized, n)"""
from lexispan.plans.tables import SQL_FOLD  # noqa: E402

_SQL_STATS = _SQL_STATS.replace("FOLDED", SQL_FOLD.format("s"))


@query(f"WITH {_SQL_STATS} SELECT * FROM stats WHERE total_count >= 5")
def ngram_stats_frequent(spark, d):
    from lexispan.plans.index_queries import opened

    return GC.frequent(opened(spark, d, "token_lists"), 5)


@query(f"""WITH {_SQL_STATS} SELECT language, n, count(*) AS n_grams, sum(total_count) AS total, max(total_count) AS top_count, sum(video_count) AS video_pairs FROM stats GROUP BY language, n""")
def ngram_stats_summary(spark, d):
    from lexispan.plans.index_queries import opened

    return GC.summary(opened(spark, d, "token_lists"))


@query(f"""WITH {SQL_STREAM}, n AS (SELECT DISTINCT doc_id, seg, token_count AS c FROM tok)
SELECT doc_id, sum(greatest(0, c) + greatest(0, c - 1) + greatest(0, c - 2) + greatest(0, c - 3) + greatest(0, c - 4)) AS n_spans FROM n GROUP BY doc_id""")
def distinct_span_counts(spark, d):
    rows = _segments(spark, d).select("doc_id", F.size(X.normalized_tokens(F.col("text"))).alias("c")).where("c > 0")
    return rows.groupBy("doc_id").agg(F.sum(K.distinct_span_count(F.col("c"), 5)).alias("n_spans"))


@query(rf"""WITH {SQL_SEGMENTS}, s AS (SELECT lang, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')) AS surface FROM segs),
f AS (SELECT lang, surface, {SQL_FOLD.format('surface')} AS normalized FROM s)
SELECT lang, normalized, count(*) AS frequency, count(DISTINCT surface) AS n_forms, min(surface) AS first_form FROM f GROUP BY lang, normalized HAVING count(DISTINCT surface) > 1""")
def form_lexicon(spark, d):
    forms = _segments(spark, d).select("lang", F.explode(X.tokens(F.col("text"))).alias("surface"))
    return forms.withColumn("normalized", X.normalize_token(F.col("surface"))).groupBy("lang", "normalized").agg(
        F.count(F.lit(1)).alias("frequency"), F.count_distinct("surface").alias("n_forms"), F.min("surface").alias("first_form")
    ).where("n_forms > 1")


@query(f"""WITH {SQL_SEGMENTS} SELECT lang, count(*) AS n_segments, sum(CASE WHEN regexp_matches(text, '[.!?…][\\])"''»”’]*\\s*$') THEN 1 ELSE 0 END) AS n_terminal,
sum(length(text)) AS chars FROM segs GROUP BY lang""")
def terminal_punctuation(spark, d):
    rows = _segments(spark, d)
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(X.ends_sentence(F.col("text"))).alias("n_terminal"), F.sum(F.length("text")).alias("chars")
    )


# The lemma route has no dictionary here: as a stand-in, sets of function words are candidates for each word.
_SQL_HITS = f"""{SQL_STREAM},
x AS (SELECT a.doc_id, a.seg, a.pos, concat_ws(' ', a.tok, b.tok) AS surface FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.seg = b.seg AND b.pos = a.pos + 1 WHERE a.tok = 'on' AND b.tok = 'the'),
l AS (SELECT a.doc_id, a.seg, a.pos, concat_ws(' ', a.tok, b.tok) AS surface FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.seg = b.seg AND b.pos = a.pos + 1 WHERE a.tok IN ('on', 'in', 'at') AND b.tok IN ('the', 'this', 'that')),
occ AS (SELECT doc_id, seg, pos, max(x) AS in_exact, max(l) AS in_lemma, min_by(surface, (CASE WHEN x = 1 THEN 0 ELSE 1 END, surface)) AS surface
 FROM (SELECT *, 1 AS x, 0 AS l FROM x UNION ALL SELECT *, 0, 1 FROM l) GROUP BY doc_id, seg, pos)"""


def _occurrences(spark, d):
    """Both routes matched in one pass: a place of either is in the token array of its row."""
    listed = _segments(spark, d).select(*SEG, X.normalized_tokens(F.col("text")).alias("toks"))
    exact = K.phrase_places(F.col("toks"), [["on"], ["the"]]).alias("x")
    lemma = K.phrase_places(F.col("toks"), [["on", "in", "at"], ["the", "this", "that"]]).alias("l")
    places = listed.select(*SEG, "toks", exact, lemma).select(*SEG, "toks", "x", "l", F.explode(F.array_union("x", "l")).alias("pos"))
    return places.select(
        *SEG, "pos", F.array_contains("x", F.col("pos")).cast("int").alias("in_exact"), F.array_contains("l", F.col("pos")).cast("int").alias("in_lemma"),
        F.array_join(F.slice("toks", F.col("pos") + 1, 2), " ").alias("surface"), F.size("toks").alias("token_count"),
    )


@query(f"WITH {_SQL_HITS} SELECT * FROM occ")
def search_route_merge(spark, d):
    return _occurrences(spark, d).drop("token_count")


@query(f"WITH {_SQL_HITS} SELECT sum(in_exact) AS exact, sum(in_lemma) AS lemma, count(*) AS auto FROM occ")
def search_totals_by_mode(spark, d):
    return S.totals(_occurrences(spark, d))


_SQL_SCORED = f"""{_SQL_HITS},
n AS (SELECT doc_id, seg, len(toks) AS token_count, length(text) AS chars, text FROM listed),
q AS (SELECT occ.*, token_count, n.text AS segment, CASE WHEN regexp_matches(n.text, '[.!?…][\\])"''»”’]*\\s*$') THEN 10000 ELSE 3800 END AS conf,
 least(9900, cast(floor((0.9 * (CASE WHEN token_count BETWEEN 5 AND 25 THEN 1.0 ELSE greatest(0.0, 1 - abs(token_count - 15) / 24.0) END)
  + 0.04 * in_exact + 0.03 * greatest(0.0, 1 - abs(0.5 - (pos + 1) / cast(greatest(token_count, 1) AS double)) * 2)) * 10000 + 0.5) AS bigint)) AS score FROM occ JOIN n USING (doc_id, seg)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY in_exact DESC, score DESC, pos) AS r FROM q) WHERE r = 1)"""


def _best(spark, d):
    long = F.when(F.col("token_count").between(5, 25), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("token_count") - 15) / 24.0))
    hits = _occurrences(spark, d).withColumn("quality", long)
    centre = (F.col("pos") + 1) / F.greatest(F.col("token_count"), F.lit(1)).cast("double")
    raw = 0.9 * F.col("quality") + 0.04 * F.col("in_exact") + 0.03 * F.greatest(F.lit(0.0), 1 - F.abs(0.5 - centre) * 2)
    scored = hits.withColumn("score", F.least(F.lit(9900), F.floor(raw * 10000 + 0.5)))
    return S.best_of_segment(scored, SEG, [F.desc("in_exact"), F.desc("score"), "pos"])


@query(f"""WITH {_SQL_SCORED}, v AS (SELECT *, 1 - in_exact AS tier, row_number() OVER (PARTITION BY 1 - in_exact, doc_id ORDER BY score DESC, doc_id, seg, pos) AS round FROM best),
page AS (SELECT *, row_number() OVER (ORDER BY tier, round, score DESC, doc_id, seg, pos) AS rank FROM v)
SELECT doc_id, seg, pos, surface, in_exact, score, round, rank FROM page WHERE rank <= 50""")
def search_ranked_diversified(spark, d):
    tiers = _best(spark, d).withColumn("tier", 1 - F.col("in_exact"))
    page = S.diversified(tiers, "tier", "doc_id", [F.desc("score"), "doc_id", "seg", "pos"], 50)
    return page.select(*SEG, "pos", "surface", "in_exact", "score", "round", "rank")


@query(f"""WITH {_SQL_SCORED} SELECT doc_id, seg, pos, concat_ws(':', doc_id, seg, pos) AS occurrence, score FROM best
ORDER BY sha256('17:' || concat_ws(':', doc_id, seg, pos)) LIMIT 50""")
def search_random_seeded(spark, d):
    rows = _best(spark, d).withColumn("occurrence", F.concat_ws(":", *[F.col(c).cast("string") for c in (*SEG, "pos")]))
    return S.random_page(rows, "occurrence", "17", 50).select(*SEG, "pos", "occurrence", "score")


@query(f"""WITH {_SQL_SCORED} SELECT doc_id, seg, pos, score, in_exact, row_number() OVER (PARTITION BY doc_id ORDER BY in_exact DESC, score DESC, seg, pos) AS rank FROM best""")
def search_rank_within_video(spark, d):
    over = Window.partitionBy("doc_id").orderBy(F.desc("in_exact"), F.desc("score"), "seg", "pos")
    return _best(spark, d).select(*SEG, "pos", "score", "in_exact", F.row_number().over(over).alias("rank"))


def _sql_stop(language: str, term: str) -> str:
    return "(" + " OR ".join(f"({language} = '{c}' AND {term} IN ({', '.join(repr(w) for w in ws)}))" for c, ws in X.STOPWORDS.items()) + ")"


@query(f"""WITH {_SQL_STATS}, top AS (SELECT * FROM stats WHERE language = 'en' ORDER BY video_count DESC, total_count DESC, n, normalized LIMIT 1000),
fine AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE 1 END AS kind FROM top WHERE len(list_filter(string_split(normalized, ' '), lambda t: NOT ({_sql_stop("'en'", 't')} OR regexp_full_match(t, '\\p{{N}}+')))) > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY video_count DESC, total_count DESC, n, normalized) AS place FROM fine)
SELECT language, normalized, n, surface, total_count, video_count, kind FROM num ORDER BY CASE WHEN place > (CASE WHEN kind = 0 THEN 10 ELSE 10 END) THEN 1 ELSE 0 END, video_count DESC, total_count DESC, n, normalized LIMIT 20""")
def suggestions_quota(spark, d):
    from lexispan.plans.index_queries import indexed_suggestions

    return indexed_suggestions(spark, d, "en", 20)


@query(rf"""WITH {SQL_SEGMENTS}, s AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')) AS surface FROM segs),
f AS (SELECT doc_id, lang, surface, {SQL_FOLD.format('surface')} AS folded FROM s)
SELECT lang, folded, sum(CASE WHEN lower(surface) = folded THEN 1 ELSE 0 END) AS plain, sum(CASE WHEN lower(surface) <> folded THEN 1 ELSE 0 END) AS accented,
count(DISTINCT doc_id) AS n_docs FROM f GROUP BY lang, folded HAVING sum(CASE WHEN lower(surface) <> folded THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN lower(surface) = folded THEN 1 ELSE 0 END) > 0""")
def accent_sensitive_bonus(spark, d):
    forms = _segments(spark, d).select("doc_id", "lang", F.explode(X.tokens(F.col("text"))).alias("surface"))
    folded = forms.withColumn("folded", X.normalize_token(F.col("surface")))
    same = F.lower("surface") == F.col("folded")
    return folded.groupBy("lang", "folded").agg(
        F.count_if(same).alias("plain"), F.count_if(~same).alias("accented"), F.count_distinct("doc_id").alias("n_docs")
    ).where("accented > 0 and plain > 0")


@query("""SELECT doc_id, 'vid_' || left(sha256('web' || chr(0) || lang || chr(0) || cast(doc_id AS varchar)), 20) AS video_key,
'trk_' || left(sha256('vid_' || left(sha256('web' || chr(0) || lang || chr(0) || cast(doc_id AS varchar)), 20) || chr(0) || 'manual' || chr(0) || lang), 20) AS track_id,
sha256(text) AS content_sha FROM documents""")
def stable_ids(spark, d):
    rows = table(spark, d, "documents")
    video = ids.video_key(F.lit("web"), F.col("lang"), F.col("doc_id"))
    return rows.select("doc_id", video.alias("video_key"), ids.track_id(video, F.lit("manual"), F.col("lang")).alias("track_id"), F.sha2("text", 256).alias("content_sha"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin,
CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 THEN round(length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) / cast(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS double), 6) END AS share FROM documents""")
def script_share(spark, d):
    rows = table(spark, d, "documents")
    letters, latin = F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.length(F.regexp_replace("text", r"[^\p{IsLatin}]", ""))
    return rows.select("doc_id", letters.alias("letters"), latin.alias("latin"), F.round(X.script_share(F.col("text")), 6).alias("share"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g'), '\s+([,.;:!?…%\])])', '\1', 'g'), '([¿¡\[(])\s+', '\1', 'g')) AS cleaned FROM documents""")
def clean_spacing(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", X.clean_spacing(F.replace("text", F.lit("\n"), F.lit(" "))).alias("cleaned"))


@query(f"""WITH {SQL_SEGMENTS}, u AS (SELECT doc_id, seg, text, length(text) AS chars, {sql_tokens('text')} AS toks FROM segs),
r AS (SELECT *, CASE WHEN len(toks) = 0 THEN 'no_tokens' WHEN len(toks) < 4 THEN 'too_short' WHEN len(toks) > 32 THEN 'too_long' WHEN NOT regexp_matches(text, '[.!?…][\\])"''»”’]*\\s*$') THEN 'no_end' ELSE 'eligible' END AS reason FROM u)
SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(chars) AS chars FROM r GROUP BY reason""")
def eligibility_funnel(spark, d):
    rows = _segments(spark, d).select("doc_id", "text", F.size(X.normalized_tokens(F.col("text"))).alias("n"))
    rules = [("no_tokens", F.col("n") == 0), ("too_short", F.col("n") < 4), ("too_long", F.col("n") > 32), ("no_end", ~X.ends_sentence(F.col("text")))]
    return rows.withColumn("reason", SA.first_failing(rules)).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("chars")
    )


@query(f"""WITH {SQL_SEGMENTS}, u AS (SELECT doc_id, seg, text, len({sql_tokens('text')}) AS n FROM segs)
SELECT doc_id, seg, n, CASE WHEN regexp_matches(text, '[.!?…][\\])"''»”’]*\\s*$') THEN 'punctuation' ELSE 'forced' END AS reason,
cast(floor((0.4 * CASE WHEN regexp_matches(text, '[.!?…][\\])"''»”’]*\\s*$') THEN 1.0 ELSE 0.38 END + 0.25 * CASE WHEN n * 0.4 BETWEEN 2 AND 12 THEN 1.0 ELSE greatest(0.0, 1 - abs(n * 0.4 - 7) / 12) END
 + 0.2 * CASE WHEN n BETWEEN 5 AND 25 THEN 1.0 ELSE greatest(0.0, 1 - abs(n - 15) / 24.0) END + 0.15 * 0.65) * 1000 + 0.5) AS bigint) AS quality FROM u""")
def segment_quality(spark, d):
    rows = _segments(spark, d).select(*SEG, "text", F.size(X.normalized_tokens(F.col("text"))).alias("n"))
    reason = F.when(X.ends_sentence(F.col("text")), "punctuation").otherwise("forced")
    lasting = F.col("n") * 0.4
    even = F.when(lasting.between(2, 12), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(lasting - 7) / 12))
    long = F.when(F.col("n").between(5, 25), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("n") - 15) / 24.0))
    quality = 0.4 * M.boundary_confidence(reason) + 0.25 * even + 0.2 * long + 0.15 * 0.65
    return rows.select(*SEG, "n", reason.alias("reason"), F.floor(quality * 1000 + 0.5).alias("quality"))
