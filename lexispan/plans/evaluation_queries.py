"""Queries of evaluation: forced alignment, resampled intervals, spans against truth, samples with quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispan.operators import forced as FA
from lexispan.operators import resampling as RS
from lexispan.operators import sampling as SA
from lexispan.operators import span_scores as SS
from lexispan.operators import storage as ST
from lexispan.plans.tables import SQL_TIMED, query, table, timed

HOUR = 3600.0
#: Vectors in a clip; a clip's frames are its vectors in order, their entries the scores of the vocabulary.
FRAMES = 40


def _clips(spark, d):
    """clip, emissions and ids: every fourth frame's best entry, which isn't the blank."""
    rows = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    scores = F.transform("embedding", lambda x: x.cast("double") * 4)
    frames = rows.select(F.expr(f"vec_id div {FRAMES}").alias("clip"), "vec_id", scores.alias("e"))
    best = F.transform("emissions", lambda e: F.greatest(F.array_position(e, F.array_max(e)) - 1, F.lit(1)).cast("int"))
    clips = FA.emissions_of(frames, ["clip"], "vec_id", "e").withColumn("best", best)
    return clips.select("clip", "emissions", F.filter("best", lambda x, i: i % 4 == 2).alias("ids"))


@query(f"""WITH RECURSIVE fr AS (SELECT vec_id // {FRAMES} AS clip, row_number() OVER (PARTITION BY vec_id // {FRAMES} ORDER BY vec_id) - 1 AS f, list_transform(embedding, lambda x: cast(x AS double) * 4) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
tk AS (SELECT clip, list(greatest(list_position(e, list_max(e)) - 1, 1) ORDER BY f) AS ids FROM fr WHERE f % 4 = 2 GROUP BY clip),
st AS (SELECT clip, s, last, CASE WHEN s % 2 = 0 THEN 0 ELSE ids[(s + 1) // 2] END AS lab, s >= 3 AND s % 2 = 1 AND ids[(s + 1) // 2] <> ids[(s - 1) // 2] AS skips FROM (SELECT clip, ids, 2 * len(ids) AS last, unnest(range(0, 2 * len(ids) + 1)) AS s FROM tk)),
r AS (SELECT fr.clip, fr.f, st.s, e[st.lab + 1] AS score, [st.s] AS path FROM fr JOIN st ON fr.clip = st.clip WHERE f = 0 AND s <= 1
  UNION ALL SELECT r.clip, r.f + 1, st.s, max(r.score) + any_value(fr.e[st.lab + 1]), list_append(arg_max(r.path, r.score), st.s)
  FROM r JOIN st ON st.clip = r.clip AND (st.s - r.s IN (0, 1) OR st.s - r.s = 2 AND st.skips) JOIN fr ON fr.clip = r.clip AND fr.f = r.f + 1 GROUP BY r.clip, r.f, st.s),
ends AS (SELECT r.clip, arg_max(path, score) AS path FROM r JOIN st USING (clip, s) WHERE s >= last - 1 AND f = (SELECT max(f) FROM fr WHERE fr.clip = r.clip) GROUP BY r.clip),
places AS (SELECT clip, generate_subscripts(path, 1) - 1 AS f, unnest(path) AS s FROM ends)
SELECT clip, s // 2 AS token, ids[s // 2 + 1] AS id, min(f) AS first_frame, max(f) + 1 AS end_frame, cast(floor(avg(exp(e[ids[s // 2 + 1] + 1])) * 1000 + 0.5) AS bigint) AS score
FROM places JOIN fr USING (clip, f) JOIN tk USING (clip) WHERE s % 2 = 1 GROUP BY clip, s, ids""")
def forced_alignment_spans(spark, d):
    """Clips of vectors taken for frames, aligned to the entries that are largest in some of them."""
    found = _clips(spark, d).withColumn("spans", FA.forced_alignment(0)("emissions", "ids"))
    rows = found.select("clip", "ids", F.explode("spans").alias("s"))
    return rows.select(
        "clip", "s.token", F.get("ids", F.col("s.token")).alias("id"), F.col("s.start").alias("first_frame"), F.col("s.end").alias("end_frame"), F.floor(F.col("s.score") * 1000 + 0.5).alias("score")
    )


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH c AS (SELECT conv_id, turn, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?s).') AS cs FROM conversations)),
g AS (SELECT *, sum(CASE WHEN regexp_matches(c, '^[ \\t\\n\\r]$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS gap, strpos('{_LETTERS}', lower(translate(c, '{FA.MARKED}', '{FA.BARE}'))) AS id FROM c)
SELECT conv_id, turn, count(*) + count(DISTINCT gap) - 1 AS n_ids, count(DISTINCT gap) AS n_words, sum(id) AS id_sum, min(i) - 1 AS first_char, max(i) AS last_char FROM g WHERE id > 0 AND length(c) = 1 GROUP BY conv_id, turn""")
def token_plan_stats(spark, d):
    """What forced alignment would be given for each turn: ids of letters, delimiters between words, places in the text."""
    vocabulary = F.create_map(*(F.lit(x) for k, c in enumerate(_LETTERS) for x in (c, k + 1)))
    plans = FA.token_plans(table(spark, d, "conversations"), ["conv_id", "turn"], F.col("text"), vocabulary, delimiter=99)
    own = F.filter("plan", lambda i: i["word"] >= 0)
    least = lambda c: F.array_min(F.transform(own, lambda i: i[c]))
    most = lambda c: F.array_max(F.transform(own, lambda i: i[c]))
    return plans.select(
        "conv_id", "turn", F.size("plan").alias("n_ids"), (most("word") + 1).alias("n_words"), F.aggregate(own, F.lit(0), lambda s, i: s + i["id"]).alias("id_sum"),
        least("start").alias("first_char"), most("end").alias("last_char"),
    )


@query("""WITH c AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256(cast(user_id AS varchar))) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS m FROM (SELECT DISTINCT event_type, user_id FROM events)),
dr AS (SELECT event_type, m, round, unnest(range(1, m + 1)) AS i FROM (SELECT DISTINCT event_type, m, unnest(range(0, 1000)) AS round FROM c)),
w AS (SELECT event_type, round, cast('0x' || substring(sha256(concat_ws(':', '7', round, i)), 1, 8) AS bigint) % m AS k FROM dr),
e AS (SELECT w.event_type, round, quantile_cont(abs(value - 50), 0.5) AS median, count(*) FILTER (WHERE abs(value - 50) <= 20) / cast(count(*) AS double) AS share FROM w JOIN c USING (event_type, k) JOIN events v ON v.event_type = w.event_type AND v.user_id = c.user_id GROUP BY w.event_type, round)
SELECT event_type, any_value(m) AS clusters, round(quantile_cont(median, 0.025), 4) AS median_abs_low, round(quantile_cont(median, 0.975), 4) AS median_abs_high, round(quantile_cont(share, 0.025), 4) AS within_low, round(quantile_cont(share, 0.975), 4) AS within_high
FROM e JOIN (SELECT DISTINCT event_type, m FROM c) USING (event_type) GROUP BY event_type""")
def timing_error_intervals(spark, d):
    """Intervals of each kind's median error and share within a tolerance, users resampled whole."""
    rows = table(spark, d, "events").select("event_type", "user_id", (F.col("value") - 50).alias("delta"))
    return RS.error_intervals(rows, ["event_type"], "user_id", "delta", 20.0, 1000, "7")


def _sql_scores(strict: bool) -> str:
    other = "k IN ('other', 'unclear')" if strict else "k = 'other'"
    return f"""WITH {SQL_TIMED}, v AS (SELECT user_id AS u, event_id AS id, start AS s, start + value * 60 AS e, CASE event_type WHEN 'view' THEN 'span' WHEN 'click' THEN 'target' WHEN 'purchase' THEN 'other' WHEN 'error' THEN 'unclear' END AS k FROM timed WHERE value > 0),
pt AS (SELECT DISTINCT u, s AS b FROM v WHERE k IS NOT NULL UNION SELECT u, e FROM v WHERE k IS NOT NULL), p AS (SELECT u, b AS s, lead(b) OVER (PARTITION BY u ORDER BY b) AS e FROM pt),
pc AS (SELECT p.u, p.s, p.e, coalesce(bool_or(k = 'target'), false) AS t, coalesce(bool_or({other}), false) AS o, coalesce(bool_or(k = 'unclear'), false) AS n, coalesce(bool_or(k = 'span'), false) AS a FROM p JOIN v ON v.u = p.u AND v.k IS NOT NULL AND v.s < p.e AND p.s < v.e WHERE p.e IS NOT NULL GROUP BY p.u, p.s, p.e),
tm AS (SELECT u, sum(e - s) FILTER (WHERE t) AS target_seconds, sum(e - s) FILTER (WHERE o) AS other_seconds, sum(e - s) FILTER (WHERE t AND a) AS accepted_target_seconds, sum(e - s) FILTER (WHERE o AND a) AS accepted_other_seconds FROM pc GROUP BY u),
sp AS (SELECT v.u, v.id, coalesce(sum(pc.e - pc.s) FILTER (WHERE t), 0) AS t, coalesce(sum(pc.e - pc.s) FILTER (WHERE o), 0) AS o, coalesce(sum(pc.e - pc.s) FILTER (WHERE n), 0) AS n FROM v JOIN pc ON pc.u = v.u AND pc.s < v.e AND v.s < pc.e WHERE k = 'span' GROUP BY v.u, v.id),
js AS (SELECT u, count(*) AS spans, count(*) FILTER (WHERE t + o > 0) AS judged_spans, count(*) FILTER (WHERE t + o > 0 AND t / (t + o) >= 0.8) AS correct_spans, count(*) FILTER (WHERE t + o > 0 AND t / (t + o) <= 0.5) AS hard_failures, sum(n) AS unjudgeable_seconds_in_spans, count(*) FILTER (WHERE n > 0) AS spans_touching_mixed_or_unsure FROM sp GROUP BY u),
tr AS (SELECT *, CASE WHEN k = 'target' AND lag(k) OVER w = 'target' AND s - lag(e) OVER w <= {HOUR} THEN 0 ELSE 1 END AS nw FROM (SELECT u, s, e, CASE WHEN k = 'target' THEN 'target' ELSE 'other' END AS k FROM v WHERE k = 'target' OR {other}) WINDOW w AS (PARTITION BY u ORDER BY s, e)),
rn AS (SELECT u, run, min(s) AS s, max(e) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY u ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM tr) WHERE k = 'target' GROUP BY u, run HAVING max(e) - min(s) >= {2 * HOUR}),
lr AS (SELECT u, run, sum(h) AS heard, sum(h) FILTER (WHERE a) AS held FROM (SELECT rn.u, run, a, least(rn.e, pc.e) - greatest(rn.s, pc.s) AS h FROM rn JOIN pc ON pc.u = rn.u AND pc.t AND pc.s < rn.e AND rn.s < pc.e) GROUP BY u, run),
lg AS (SELECT u, count(*) AS long_runs, count(*) FILTER (WHERE coalesce(held, 0) >= 0.5 * heard) AS long_runs_half_covered, sum(heard) AS long_run_target_seconds, sum(held) AS long_run_accepted_seconds FROM lr GROUP BY u)
SELECT u AS user_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*SS.COUNTS, 'spans_touching_mixed_or_unsure'))}, {', '.join(f'cast(floor(coalesce({c}, 0) + 0.5) AS bigint) AS {c}' for c in (*SS.SECONDS, 'unjudgeable_seconds_in_spans'))},
round(correct_spans / cast(nullif(judged_spans, 0) AS double), 4) AS span_precision, round(coalesce(accepted_target_seconds, 0) / nullif(target_seconds, 0), 4) AS time_recall FROM tm LEFT JOIN js USING (u) LEFT JOIN lg USING (u)"""


def _judged(spark, d):
    rows = timed(spark, d).where("value > 0").withColumn("end", F.col("start") + F.col("value") * 60)
    kind = F.when(F.col("event_type") == "click", "target").when(F.col("event_type") == "purchase", "other").when(F.col("event_type") == "error", "mixed")
    return rows.where("event_type = 'view'"), rows.where("event_type != 'view'").withColumn("kind", kind).where("kind is not null")


def _scores(spark, d, strict):
    spans, labels = _judged(spark, d)
    found = SS.rates(SS.score(spans, labels, "user_id", "event_id", strict, join_gap=HOUR, long_run=2 * HOUR, width=24 * HOUR))
    whole = [F.floor(F.col(c) + 0.5).alias(c) for c in (*SS.SECONDS, "unjudgeable_seconds_in_spans")]
    return found.select("user_id", *SS.COUNTS, "spans_touching_mixed_or_unsure", *whole, F.round("span_precision", 4).alias("span_precision"), F.round("time_recall", 4).alias("time_recall"))


@query(_sql_scores(False))
def span_scores_lenient(spark, d):
    return _scores(spark, d, False)


@query(_sql_scores(True))
def span_scores_strict(spark, d):
    return _scores(spark, d, True)


_STRATA = [("view", 60), ("click", 25), ("purchase", 40), ("error", 5_000)]


def _sample(spark, d):
    rows = timed(spark, d).where("value > 0").withColumn("end", F.col("start") + F.col("value") * 60)
    asked = rows.where(F.col("event_type").isin([k for k, _ in _STRATA])).select("event_id", "user_id", "event_type", "start", "end")
    return SA.quota_sample(asked, _STRATA, "event_type", "user_id", "event_id", "11", 3, HOUR, 24 * HOUR)


@query()
def quota_sample(spark, d):
    """Events in a seeded order under quotas of their kind, a cap for each user and a distance; a pass over all of them in order isn't in SQL."""
    return _sample(spark, d).select("event_id", "event_type", "user_id", "fate")


@query()
def quota_sample_report(spark, d):
    return SA.sample_report(_sample(spark, d), _STRATA, "event_type", "user_id")


@query("""WITH l AS (SELECT *, 'clp_' || left(sha256(cast(l_partkey AS varchar)), 20) AS ck FROM lineitem), v AS (SELECT o_orderkey AS k, o_orderpriority AS channel FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN min(l_suppkey) END AS src FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus), c AS (SELECT DISTINCT l_orderkey AS k, ck FROM l WHERE l_quantity > 10),
f AS (SELECT l_orderkey AS k, cast(l_quantity AS bigint) AS b, CASE l_linenumber % 4 WHEN 1 THEN CASE WHEN v.k IS NULL THEN 'orphan' ELSE 'raw_manifest' END WHEN 2 THEN CASE WHEN v.k IS NULL THEN 'orphan' WHEN l_suppkey = src THEN 'raw_source' ELSE 'unrecognized' END
 ELSE CASE WHEN v.k IS NULL THEN 'orphan' WHEN c.k IS NULL THEN 'invalid_manifest' WHEN l_linenumber % 4 = 3 THEN 'clip_manifest' ELSE 'clip' END END AS class
 FROM l LEFT JOIN v ON v.k = l_orderkey LEFT JOIN r ON r.k = l_orderkey LEFT JOIN c ON c.k = l_orderkey AND c.ck = l.ck)
SELECT class, count(*) AS files, sum(b) AS bytes, count(DISTINCT k) AS videos FROM f GROUP BY class""")
def storage_classes(spark, d):
    """Lines of orders as stored files: manifests, recordings and clips of videos, some without captions or a readable manifest."""
    rows = table(spark, d, "lineitem").select("*", F.concat(F.lit("clp_"), F.left(F.sha2(F.col("l_partkey").cast("string"), 256), F.lit(20))).alias("ck"), F.col("l_orderkey").cast("string").alias("k"))
    orders = table(spark, d, "orders").select("*", F.col("o_orderkey").cast("string").alias("k"))
    raw, clip, turn = F.concat_ws("/", F.lit(ST.RAW), F.lit("xx"), "k"), F.concat_ws("/", F.lit(ST.CLIPS), F.lit("xx"), "k", "ck"), F.col("l_linenumber") % 4
    source = F.concat(F.col("l_suppkey").cast("string"), F.lit(".m4a"))
    path = F.when(turn == 1, F.concat_ws("/", raw, F.lit(ST.MANIFEST))).when(turn == 2, F.concat_ws("/", raw, source)).when(turn == 3, F.concat_ws("/", clip, F.lit(ST.MANIFEST))).otherwise(F.concat_ws("/", clip, F.lit("c.ogg")))
    named = lambda df: df.withColumns({"language": F.lit("xx"), "video_key": F.col("k")})
    videos = named(orders.where("o_orderstatus != 'P'")).select("language", "video_key", F.col("o_orderpriority").alias("channel"))
    least = rows.groupBy("k").agg(F.concat(F.min("l_suppkey").cast("string"), F.lit(".m4a")).alias("source_file"))
    manifests = named(orders.join(least, "k")).select("language", "video_key", F.when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status"), "source_file")
    clips = named(rows.where("l_quantity > 10").select("k", F.col("ck").alias("clip_key")).distinct()).select("language", "video_key", "clip_key", F.lit("c.ogg").alias("clip_file"))
    found = ST.classified(rows.select(path.alias("path"), F.col("l_quantity").cast("long").alias("bytes")), videos, manifests, clips)
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_distinct("video_key").alias("videos"))
