"""Queries over reports and checks: stores, timing systems, spans and units, caches, audio, reviews, acquisition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.operators import intervals as I
from lexispan.operators import reports as R
from lexispan.operators import tokens as K
from lexispan.plans.tables import SQL_STREAM, SQL_TIMED, query, table, timed

BUCKET = 6 * 3600.0


@query("""SELECT 'status' AS kind, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'license', o_orderpriority, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT 'total', NULL, count(*) FROM orders UNION ALL SELECT 'non_commercial', NULL, count(*) FILTER (WHERE list_contains(string_split(lower(o_orderpriority), '-'), 'low')) FROM orders""")
def store_statistics(spark, d):
    return R.store_statistics(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "low")


_SQL_RESULTS = """x AS (SELECT l_orderkey, l_returnflag AS language, l_linestatus AS source_class, min(l_suppkey) AS video, CASE WHEN min(l_quantity) < 3 THEN 'failed' ELSE 'complete' END AS status,
 max(l_tax) AS coverage, max(l_quantity) / 16 AS seconds, max(l_quantity) AS clip_end FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_SQL_RESULTS}, c AS (SELECT language, source_class, count(*) FILTER (WHERE status = 'complete') AS segments, count(DISTINCT video) FILTER (WHERE status = 'complete') AS videos,
 floor(avg(coverage) FILTER (WHERE status = 'complete') * 10000 + 0.5) / 10000 AS coverage, count(*) FILTER (WHERE status = 'failed') AS failures, floor(sum(seconds) / sum(clip_end) * 10000 + 0.5) / 10000 AS seconds_per_audio_second FROM x GROUP BY ALL),
e AS (SELECT language, source_class, l_discount - 0.04 AS delta FROM lineitem JOIN x ON x.l_orderkey = lineitem.l_orderkey AND language = l_returnflag AND source_class = l_linestatus WHERE status = 'complete'),
q AS (SELECT language, source_class, count(*) AS words, floor(quantile_cont(abs(delta), 0.5) * 10000 + 0.5) / 10000 AS median_abs, floor(quantile_cont(abs(delta), 0.9) * 10000 + 0.5) / 10000 AS p90_abs,
 floor(quantile_cont(delta, 0.5) * 10000 + 0.5) / 10000 AS median_signed, floor(count(*) FILTER (WHERE abs(delta) <= 0.015) / count(*) * 10000 + 0.5) / 10000 AS within_15ms, floor(count(*) FILTER (WHERE abs(delta) <= 0.035) / count(*) * 10000 + 0.5) / 10000 AS within_35ms FROM e GROUP BY ALL)
SELECT *, segments < 50 AS indicative_only FROM c JOIN q USING (language, source_class)""")
def system_summary(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("source_class"))
    results = rows.agg(
        F.min("l_suppkey").alias("video"),
        F.when(F.min("l_quantity") < 3, "failed").otherwise("complete").alias("status"),
        F.max("l_tax").alias("coverage"),
        (F.max("l_quantity") / 16).alias("seconds"),
        F.lit(0.0).alias("clip_start"),
        F.max("l_quantity").alias("clip_end"),
        F.collect_list(F.col("l_discount") - 0.04).alias("deltas"),
    )
    return R.system_summary(results, ["language", "source_class"], [0.015, 0.035])


@query("""WITH l AS (SELECT *, l_extendedprice / 1024 AS start, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
r AS (SELECT l_orderkey, l_returnflag, arg_max(start + l_discount, ord) AS other FROM l WHERE l_tax < 0.06 GROUP BY ALL), e AS (SELECT start - other AS delta FROM l JOIN r USING (l_orderkey, l_returnflag))
SELECT count(*) AS pairs, floor(quantile_cont(abs(delta), 0.5) * 10000 + 0.5) / 10000 AS median_abs, floor(quantile_cont(abs(delta), 0.9) * 10000 + 0.5) / 10000 AS p90_abs, floor(quantile_cont(delta, 0.5) * 10000 + 0.5) / 10000 AS median_signed,
floor(count(*) FILTER (WHERE abs(delta) <= 10.0) / count(*) * 10000 + 0.5) / 10000 AS "within" FROM e""")
def engine_agreement(spark, d):
    rows = table(spark, d, "lineitem").withColumn("start", F.col("l_extendedprice") / 1024)
    other = rows.where("l_tax < 0.06").withColumn("start", F.col("start") + F.col("l_discount")).withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return R.engine_agreement(rows, other, ["l_orderkey", "l_returnflag"], 10.0)


_SQL_COVERED = f"""{SQL_TIMED}, u AS (SELECT event_id, user_id, event_type, value, start, start + value * 60 AS "end" FROM timed),
o AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u WHERE event_type = 'click' AND "end" > start),
m AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
s AS (SELECT user_id, island, min(start) AS start, max("end") AS "end" FROM m GROUP BY user_id, island),
c AS (SELECT event_id, sum(least(u."end", s."end") - greatest(u.start, s.start)) AS inside FROM u JOIN s ON u.user_id = s.user_id AND u.start < s."end" AND s.start < u."end" GROUP BY event_id),
j AS (SELECT u.*, coalesce(inside, 0) AS inside, u."end" - start AS lasting FROM u LEFT JOIN c USING (event_id) WHERE event_type <> 'click')"""


def _covered(spark, d):
    rows = timed(spark, d).withColumn("end", F.col("start") + F.col("value") * 60)
    return R.covered(rows.where("event_type != 'click'"), rows.where("event_type = 'click'"), "user_id", "event_id", BUCKET)


@query(f"""WITH {_SQL_COVERED} SELECT CASE WHEN value < 20 THEN 'short' WHEN value < 60 THEN 'medium' ELSE 'long' END || CASE WHEN event_type = 'purchase' THEN '-inline' ELSE '' END AS bucket,
count(*) AS utterances, count(*) FILTER (WHERE inside >= 0.5 * lasting) AS half_covered FROM j WHERE event_type <> 'error' GROUP BY bucket""")
def half_covered_recall(spark, d):
    bucket = F.when(F.col("value") < 20, "short").when(F.col("value") < 60, "medium").otherwise("long")
    judged = _covered(spark, d).where("event_type != 'error'").withColumn("bucket", F.concat(bucket, F.when(F.col("event_type") == "purchase", "-inline").otherwise("")))
    return R.half_covered_recall(judged, ["bucket"])


@query(f"""WITH {_SQL_COVERED} SELECT count(*) AS units, count(*) FILTER (WHERE inside <= 1e-6) AS untouched, count(*) FILTER (WHERE inside > 1e-6 AND inside < lasting - 0.05) AS partially_cut,
count(*) FILTER (WHERE inside > 1e-6 AND inside >= lasting - 0.05) AS fully_inside_a_span, cast(floor(sum(lasting) + 0.5) AS bigint) AS seconds, cast(floor(sum(inside) + 0.5) AS bigint) AS covered_seconds,
cast(floor(sum(inside) / sum(lasting) * 10000 + 0.5) AS bigint) AS covered_fraction FROM j WHERE event_type = 'error'""")
def mixed_unit_report(spark, d):
    out = R.mixed_unit_report(_covered(spark, d).where("event_type = 'error'"))
    whole = {"seconds": F.floor(F.col("seconds") + 0.5), "covered_seconds": F.floor(F.col("covered_seconds") + 0.5), "covered_fraction": F.floor(F.col("covered_fraction") * 10000 + 0.5)}
    return out.withColumns(whole)


@query(f"""WITH {_SQL_COVERED}, p AS (SELECT s.user_id, island, value, u.start >= s.start - 1e-6 AND u."end" <= s."end" + 1e-6 AS held FROM s JOIN u ON u.user_id = s.user_id AND u.start < s."end" AND s.start < u."end" WHERE event_type <> 'click')
SELECT user_id, island, CASE WHEN bool_or(held) THEN count(*) FILTER (WHERE held) ELSE count(*) END AS n_windows, cast(floor(coalesce(avg(value) FILTER (WHERE held), avg(value)) * 1000 + 0.5) AS bigint) AS mean FROM p GROUP BY user_id, island""")
def run_window_means(spark, d):
    rows = timed(spark, d).withColumn("end", F.col("start") + F.col("value") * 60)
    runs = I.islands(rows.where("event_type = 'click'"), ["user_id"])
    out = R.run_means(runs, rows.where("event_type != 'click'"), "user_id", ["user_id", "island"], "value", BUCKET)
    return out.withColumn("mean", F.floor(F.col("mean") * 1000 + 0.5))


@query("""SELECT conv_id, turn, key, cast(sum(n) AS bigint) AS n FROM (SELECT conv_id, turn, unnest(['input', 'cached', 'input', 'output']) AS key, unnest([length(text), turn, turn + 1, length(role)]) AS n FROM conversations) GROUP BY ALL""")
def usage_merge(spark, d):
    rows = table(spark, d, "conversations")
    pairs = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v.cast("bigint"))])
    merged = R.merged_usage(pairs(("input", F.length("text")), ("cached", F.col("turn"))), pairs(("input", F.col("turn") + 1), ("output", F.length("role"))))
    return rows.select("conv_id", "turn", F.explode(merged).alias("key", "n"))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def bounded_history(spark, d):
    return R.newest(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"], 50).select("o_orderkey", "o_orderstatus", "o_orderdate")


_SQL_ENTRIES = """e AS (SELECT 'translation' AS stage, o_orderkey AS cache_key, o_orderstatus AS target_language, o_orderpriority AS provider, o_orderdate AS last_accessed_at FROM orders
UNION ALL SELECT 'alignment', l_orderkey, l_linestatus, l_returnflag, l_shipdate FROM lineitem)"""


@query(f"""WITH {_SQL_ENTRIES} SELECT * FROM e WHERE target_language = 'O' AND last_accessed_at < timestamp '2000-06-01' - interval 30 day ORDER BY last_accessed_at DESC, stage, cache_key, provider LIMIT 100""")
def cache_listing(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("cache_key"), F.col("o_orderstatus").alias("target_language"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("last_accessed_at")
    )
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cache_key"), F.col("l_linestatus").alias("target_language"), F.col("l_returnflag").alias("provider"), F.col("l_shipdate").alias("last_accessed_at")
    )
    now = F.lit("2000-06-01").cast("timestamp")
    return R.cache_listing({"translation": orders, "alignment": lines}, ["cache_key", "provider"], 100, target_language="O", older_than_days=30, now=now)


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS id, max(l_quantity) AS chars FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey AS k, l_suppkey AS id, min(l_quantity) AS chars FROM lineitem GROUP BY ALL),
e AS (SELECT l_orderkey AS k, l_linenumber AS source, l_suppkey AS target FROM lineitem WHERE l_discount < 0.05), es AS (SELECT DISTINCT k, source AS id, 1 AS hit FROM e), et AS (SELECT DISTINCT k, target AS id, 1 AS hit FROM e),
x AS (SELECT k, sum(chars) FILTER (WHERE hit = 1) AS linked, count(hit) / count(*) AS share FROM s LEFT JOIN es USING (k, id) GROUP BY k), y AS (SELECT k, sum(chars) FILTER (WHERE hit = 1) AS linked, count(hit) / count(*) AS share FROM t LEFT JOIN et USING (k, id) GROUP BY k),
n AS (SELECT k, count(*) AS edge_count FROM e GROUP BY k), z AS (SELECT l_orderkey AS k, sum(l_quantity) AS chars FROM lineitem GROUP BY ALL)
SELECT k, coalesce(edge_count, 0) AS edge_count, floor(coalesce(x.linked, 0) / greatest(1, chars) * 10000 + 0.5) / 10000 AS source_character_coverage, floor(coalesce(y.linked, 0) / greatest(1, chars) * 10000 + 0.5) / 10000 AS target_character_coverage,
floor(x.share * 10000 + 0.5) / 10000 AS source_token_coverage, floor(y.share * 10000 + 0.5) / 10000 AS target_token_coverage FROM z LEFT JOIN x USING (k) LEFT JOIN y USING (k) LEFT JOIN n USING (k)""")
def link_quality(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    texts = rows.groupBy("k").agg(F.sum("l_quantity").alias("source_chars"), F.sum("l_quantity").alias("target_chars"))
    sources = rows.groupBy("k", F.col("l_linenumber").alias("id")).agg(F.max("l_quantity").alias("chars"))
    targets = rows.groupBy("k", F.col("l_suppkey").alias("id")).agg(F.min("l_quantity").alias("chars"))
    edges = rows.where("l_discount < 0.05").select("k", F.col("l_linenumber").alias("source"), F.col("l_suppkey").alias("target"))
    return R.link_quality(texts, sources, targets, edges, "k")


@query(f"""WITH {SQL_STREAM} SELECT lang, count(*) AS n_segments, count(*) FILTER (WHERE regexp_matches(text, '[぀-ヿ㐀-鿿]') AND len(toks) <= 1) AS unreliable, count(*) FILTER (WHERE len(toks) <= 1) AS single FROM listed GROUP BY lang""")
def unreliable_cjk_segments(spark, d):
    rows = K.segments(table(spark, d, "documents")).withColumn("n", F.size(X.normalized_tokens(F.col("text"))))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(R.unreliable_cjk(F.col("text"), F.lit("unicode"), F.col("n"))).alias("unreliable"), F.count_if(F.col("n") <= 1).alias("single")
    )


@query("SELECT l_orderkey, count(DISTINCT (l_quantity, l_linenumber)) >= 2 AS granular FROM lineitem GROUP BY l_orderkey")
def granular_timing(spark, d):
    timing = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("char_start"), F.col("l_linenumber").alias("char_end"))
    return R.granular_timing(timing, ["l_orderkey"])


@query(f"""WITH {SQL_TIMED} SELECT event_type AS language, count(*) AS checked, count(*) FILTER (WHERE CASE WHEN value < 30 THEN event_type ELSE 'view' END = event_type) AS top1_correct FROM timed WHERE "end" - start >= 1.5 GROUP BY event_type""")
def voice_check(spark, d):
    rows = timed(spark, d).withColumnRenamed("event_type", "language").withColumn("top", F.when(F.col("value") < 30, F.col("language")).otherwise("view"))
    return R.voice_check(rows, ["language"])


@query(f"""WITH {SQL_TIMED}, c AS (SELECT event_id AS clip_id, user_id, start AS clip_start, start + value * 60 AS clip_end FROM timed WHERE event_type = 'view'), u AS (SELECT user_id, start, CASE WHEN value < 2 THEN ' ' ELSE event_type END AS text FROM timed WHERE event_type <> 'view')
SELECT clip_id, text, floor((start - clip_start) * 10000 + 0.5) / 10000 AS start FROM c JOIN u USING (user_id) WHERE start BETWEEN clip_start AND clip_end AND trim(text) <> ''""")
def reference_starts(spark, d):
    rows = timed(spark, d)
    clips = rows.where("event_type = 'view'").select(F.col("event_id").alias("clip_id"), "user_id", F.col("start").alias("clip_start"), (F.col("start") + F.col("value") * 60).alias("clip_end"))
    units = rows.where("event_type != 'view'").select("user_id", "start", F.when(F.col("value") < 2, " ").otherwise(F.col("event_type")).alias("text"))
    return R.reference_starts(units, clips, "user_id", BUCKET)


@query("""SELECT conv_id, cast(sum(length(text)) AS bigint) AS length, count(*) FILTER (WHERE s >= 50 AND e <= 2000) AS n_contained FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e,
sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS s FROM conversations) GROUP BY conv_id""")
def contained_tokens(spark, d):
    end = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    placed = table(spark, d, "conversations").select("conv_id", F.length("text").alias("n"), end.alias("end")).withColumn("start", F.col("end") - F.col("n"))
    found = placed.groupBy("conv_id").agg(F.sum("n").alias("length"), F.collect_list(F.struct("start", "end")).alias("tokens"))
    return found.select("conv_id", "length", F.size(R.contained(F.col("tokens"), F.lit(50), F.lit(2000))).alias("n_contained"))


@query("""SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 10 END, lang) AS place FROM (SELECT DISTINCT source, lang FROM documents)""")
def language_key_order(spark, d):
    return R.priority_order(table(spark, d, "documents").select("source", "lang").distinct(), ["source"], "lang", {"fr": 0, "en": 1})


_SQL_AUDIO = """a AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'ECONOMY' THEN 'failed' ELSE 'ready' END AS manifest_status, p_size <> 7 AS has_raw, CASE WHEN p_size = 9 THEN '.wav' ELSE 'wav' END AS extension,
 CASE WHEN p_size < 5 THEN 'none' ELSE sha256(p_name) END AS checksum, p_size - 12 AS size_bytes FROM part), f AS (SELECT l_partkey, cast(max(l_quantity) AS int) AS most FROM lineitem WHERE l_tax > 0.02 GROUP BY l_partkey)"""


@query(f"""WITH {_SQL_AUDIO}, r AS (SELECT a.*, CASE WHEN manifest_status IS NULL THEN NULL WHEN manifest_status = 'failed' THEN 'acquisition failed' WHEN NOT has_raw THEN 'no audio record' WHEN extension = '.wav' THEN 'unusable extension' WHEN checksum = 'none' THEN 'no valid checksum'
WHEN size_bytes <= 0 THEN 'no valid byte count' WHEN most IS NULL THEN 'payload missing' WHEN most > 45 THEN 'size differs' WHEN most > 40 THEN 'checksum differs' END AS error FROM a LEFT JOIN f ON p_partkey = l_partkey)
SELECT p_partkey, CASE WHEN manifest_status IS NULL THEN 'missing' WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS status, error FROM r""")
def audio_status(spark, d):
    files = table(spark, d, "lineitem").where("l_tax > 0.02").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("int").alias("most"))
    kind, size = F.col("p_type"), F.col("p_size")
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.when(kind == "PROMO", None).when(kind == "ECONOMY", "failed").otherwise("ready").alias("manifest_status"),
        (size != 7).alias("has_raw"),
        F.when(size == 9, ".wav").otherwise("wav").alias("extension"),
        F.when(size < 5, "none").otherwise(F.sha2("p_name", 256)).alias("checksum"),
        (size - 12).alias("size_bytes"),
    )
    most = F.col("most")
    found = rows.join(files, "p_partkey", "left").withColumn("found_size", F.when(most.isNotNull(), F.when(most > 45, 0).otherwise(F.col("size_bytes"))))
    return R.audio_status(found.withColumn("found_checksum", F.when(most <= 40, F.col("checksum"))), True).select("p_partkey", "status", "error")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_type = 'PROMO' THEN 'container' END, CASE WHEN p_brand = 'Brand#2' THEN 'codec' END, CASE WHEN p_size < 10 THEN 'rate' END, CASE WHEN p_size > 40 THEN 'channels' END, CASE WHEN abs(p_retailprice - 1000) > 50 THEN 'duration' END) AS problems FROM part""")
def prepared_clip_problems(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_type") == "PROMO", "ogg").otherwise("wav").alias("format"),
        F.when(F.col("p_brand") == "Brand#2", "opus").otherwise("pcm_s16le").alias("codec"),
        F.when(F.col("p_size") < 10, 48_000).otherwise(16_000).alias("sample_rate"),
        F.when(F.col("p_size") > 40, 2).otherwise(1).alias("channels"),
        F.col("p_retailprice").alias("duration_ms"),
        F.lit(1000).alias("expected_ms"),
    )
    return rows.select("p_partkey", F.array_join(R.clip_problems(), ",").alias("problems"))


@query("""WITH e AS (SELECT l_orderkey, max(l_returnflag) AS flag, count(*) AS n, max(l_shipdate) AS at FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(l_returnflag) AS flag, count(*) AS n, max(l_shipdate) AS at FROM lineitem WHERE l_tax < 0.08 GROUP BY ALL)
SELECT e.*, m.l_orderkey IS NOT NULL AND e.flag IS NOT DISTINCT FROM m.flag AND e.n IS NOT DISTINCT FROM m.n AND e.at IS NOT DISTINCT FROM m.at AS valid FROM e LEFT JOIN m USING (l_orderkey)""")
def clip_cache_validity(spark, d):
    rows = table(spark, d, "lineitem")
    made = lambda df: df.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("at"))
    return R.valid_clips(made(rows), made(rows.where("l_tax < 0.08")), "l_orderkey", ["flag", "n", "at"])


@query("""WITH c AS (SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE n_chars < 500) AS missing, count(*) FILTER (WHERE n_chars >= 500) AS ready FROM documents GROUP BY ALL)
SELECT lang, string_agg(source || ':' || total || ':' || ready || ':' || missing, ',' ORDER BY source) AS channels FROM c GROUP BY lang""")
def status_projection(spark, d):
    rows = table(spark, d, "documents").withColumn("status", F.when(F.col("n_chars") < 500, "missing").otherwise("ready"))
    told = lambda c: F.concat_ws(":", c["source"], *[c[n].cast("string") for n in ("total", "ready", "missing")])
    return R.status_projection(rows, "lang", "source", "status", ["ready", "missing"]).select("lang", F.array_join(F.transform("channels", told), ",").alias("channels"))


@query("""WITH r AS (SELECT l_linenumber - 1 AS s, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS d, CASE WHEN l_tax > 0.04 THEN 2 ELSE 0 END AS i, CASE WHEN l_quantity < 5 THEN 0 ELSE l_quantity END AS n FROM lineitem),
a AS (SELECT CASE WHEN n > 0 THEN (s + d + i) / n WHEN s + d + i = 0 THEN 0 END AS rate FROM r) SELECT CASE WHEN rate IS NULL THEN 'unavailable' ELSE 'complete' END AS status, CASE WHEN rate IS NULL THEN 'empty_reference' END AS error, count(*) AS n,
count(*) FILTER (WHERE 1 - rate >= 0.9) AS n_agreeing FROM a GROUP BY 1, 2""")
def caption_agreement_feature(spark, d):
    flag = lambda c, v: F.when(c, v).otherwise(0)
    feature = R.agreement_feature(
        F.col("l_linenumber") - 1, flag(F.col("l_discount") > 0.05, 1), flag(F.col("l_tax") > 0.04, 2), F.when(F.col("l_quantity") < 5, 0.0).otherwise(F.col("l_quantity"))
    )
    rows = table(spark, d, "lineitem").select(feature.alias("f")).select("f.*")
    return rows.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("agreement") >= 0.9).alias("n_agreeing"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'first' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'second' END AS stratum, count(*) AS n FROM orders GROUP BY ALL""")
def stratum_assignment(spark, d):
    strata = [("first", "F", "5-LOW"), ("second", "O", "1-URGENT"), ("third", "F", "5-LOW")]
    rows = table(spark, d, "orders").withColumn("stratum", R.stratum(F.col("o_orderstatus"), F.col("o_orderpriority"), strata))
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT lang, count(*) AS available, count(quality) AS labelled, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT *, concat_ws(',', CASE WHEN available < 200 THEN 'too few' END, CASE WHEN labelled * 3 < available THEN 'too few labels' END, CASE WHEN blank > 0 THEN 'blank texts' END) AS blockers, available >= 200 AND labelled * 3 >= available AND blank = 0 AS ready FROM a""")
def preflight(spark, d):
    rows = R.with_evidence(table(spark, d, "documents").select("doc_id", "lang", "text"), table(spark, d, "labels"), "doc_id")
    blank = F.col("text").isNull() | (F.trim("text") == "")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("available"), F.count("quality").alias("labelled"), F.count_if(blank).alias("blank"))
    checks = [("too few", F.col("available") < 200), ("too few labels", F.col("labelled") * 3 < F.col("available")), ("blank texts", F.col("blank") > 0)]
    return R.preflight(counts, checks).withColumn("blockers", F.array_join("blockers", ","))


@query("""SELECT o_orderkey, coalesce(d.verdict, o_orderstatus) AS verdict, d.l_orderkey IS NOT NULL AS imported FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS verdict FROM lineitem WHERE l_tax > 0.05 GROUP BY l_orderkey) d ON o_orderkey = l_orderkey""")
def review_import(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("verdict"))
    decisions = table(spark, d, "lineitem").where("l_tax > 0.05").withColumnsRenamed({"l_orderkey": "o_orderkey", "l_returnflag": "verdict"})
    return R.with_decisions(rows, decisions, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "verdict"], ["verdict"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def catalogue_seeds(spark, d):
    present = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return R.not_yet_there(table(spark, d, "part").select("p_partkey", "p_name"), present, "p_partkey")


@query("SELECT lang, l.doc_id IS NULL AS missing, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def evidence_join(spark, d):
    rows = R.with_evidence(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang", "missing").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR event_type <> 'view' AND event_id % 11 = 0 THEN 'live' WHEN value < 60 AND event_type <> 'click' THEN 'short' WHEN value > 150 THEN 'no captions' ELSE 'eligible' END AS reason FROM events")
def candidate_skips(spark, d):
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "is_live").alias("live_status"),
        F.when(F.col("event_type") != "view", F.col("event_id") % 11 == 0).alias("is_live"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("duration"),
        (F.col("value") <= 150).alias("has_captions"),
    )
    return rows.select("event_id", R.skip_reason().alias("reason"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'missing format_id' WHEN l_tax = 0 THEN 'no audio codec' WHEN l_discount = 0 THEN 'digital restrictions' WHEN l_returnflag = 'R' THEN 'codec' WHEN l_quantity < 8 THEN 'bitrate' WHEN l_linenumber = 1 THEN 'sample rate'
WHEN l_linestatus = 'F' THEN 'dubbed' ELSE 'eligible' END AS reason FROM lineitem) GROUP BY reason""")
def format_rejections(spark, d):
    formats = table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_partkey").cast("string")).alias("format_id"),
        F.when(F.col("l_tax") != 0, F.col("l_returnflag")).alias("family"),
        (F.col("l_discount") == 0).alias("has_drm"),
        (F.col("l_quantity") * 4).alias("abr"),
        (F.col("l_linenumber") * 8000).alias("asr"),
        F.concat(F.lower("l_linestatus"), F.lit("-X")).alias("language"),
    )
    return formats.groupBy(R.format_rejection("o", ["A", "N"], 32, 16_000).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
