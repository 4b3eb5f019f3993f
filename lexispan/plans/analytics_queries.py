"""Queries over timed intervals, statistics, agreement, sampling and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispan.functions import ids
from lexispan.functions import measures as M
from lexispan.operators import caches as C
from lexispan.operators import intervals as I
from lexispan.operators import sampling as SA
from lexispan.operators import scoring as R
from lexispan.operators import segmenting as G
from lexispan.plans.tables import SQL_TIMED, query, table, timed

HOUR = 3600.0


def _ints(df, *names):
    """Seconds as whole milliseconds, so that engines agree to the last digit."""
    return [F.floor(F.col(n) * 1000 + 0.5).alias(n) for n in names]


def _sql_ms(*names):
    return ", ".join(f'cast(floor("{n}" * 1000 + 0.5) AS bigint) AS "{n}"' for n in names)


def _clicks(spark, d):
    """Long intervals, so that neighbours of a user overlap: an hour for each unit of value."""
    return timed(spark, d).withColumn("end", F.col("start") + F.col("value") * 60)


_SQL_CLICKS = f"""{SQL_TIMED}, clicks AS (SELECT event_id, user_id, event_type, value, start, start + value * 60 AS "end" FROM timed)"""
_SQL_ISLANDS = f"""{_SQL_CLICKS}, o AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM clicks WHERE "end" > start),
m AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
islands AS (SELECT user_id, island, min(start) AS start, max("end") AS "end", count(*) AS n FROM m GROUP BY user_id, island)"""


@query(f'WITH {_SQL_ISLANDS} SELECT user_id, island, {_sql_ms("start", "end")}, n FROM islands')
def interval_union(spark, d):
    found = I.islands(_clicks(spark, d), ["user_id"])
    return found.select("user_id", "island", *_ints(found, "start", "end"), "n")


@query(f'WITH {_SQL_ISLANDS} SELECT user_id, cast(floor(sum("end" - start) + 0.5) AS bigint) AS covered, count(*) AS n_islands FROM islands GROUP BY user_id')
def interval_coverage(spark, d):
    found = I.union_length(_clicks(spark, d), ["user_id"])
    return found.select("user_id", F.floor(F.col("covered") + 0.5).alias("covered"), "n_islands")


@query(f"""WITH {_SQL_CLICKS} SELECT l.event_id AS view_id, count(*) AS n_overlapping, cast(floor(sum(least(l."end", r."end") - greatest(l.start, r.start)) + 0.5) AS bigint) AS overlap_s
FROM clicks l JOIN clicks r ON l.user_id = r.user_id AND l.start < r."end" AND r.start < l."end" WHERE l.event_type = 'view' AND r.event_type = 'click' GROUP BY l.event_id""")
def interval_overlap_join(spark, d):
    rows = _clicks(spark, d)
    pairs = I.overlap_join(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), "user_id", 6 * HOUR)
    shared = I.overlap(*[F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")])
    return pairs.groupBy(F.col("l.event_id").alias("view_id")).agg(
        F.count(F.lit(1)).alias("n_overlapping"), F.floor(F.sum(shared) + 0.5).alias("overlap_s")
    )


@query(f"""WITH {_SQL_CLICKS} SELECT p.event_id AS point_id, count(*) AS n_spans, min(s.event_id) AS first_span FROM clicks p JOIN clicks s ON p.user_id = s.user_id AND p.start >= s.start AND p.start < s."end"
WHERE p.event_type = 'purchase' AND s.event_type <> 'purchase' GROUP BY p.event_id""")
def point_in_interval(spark, d):
    rows = _clicks(spark, d)
    points = rows.where("event_type = 'purchase'").select("event_id", "user_id", F.col("start").alias("at"))
    found = I.point_lookup(points, rows.where("event_type != 'purchase'"), "user_id", 6 * HOUR)
    return found.groupBy(F.col("p.event_id").alias("point_id")).agg(F.count(F.lit(1)).alias("n_spans"), F.min("s.event_id").alias("first_span"))


@query(f"""WITH {SQL_TIMED}, e AS (SELECT event_id, start, start + value AS "end" FROM timed WHERE value > 0),
w AS (SELECT event_id, start, "end", unnest(range(0, cast(CASE WHEN "end" - start <= 30 THEN 0 ELSE ceil(("end" - start - 30) / 15) END AS bigint) + 1)) AS w FROM e)
SELECT event_id, w, {_sql_ms("w_start", "w_end")} FROM (SELECT *, greatest(start, least(start + w * 15, "end" - 30)) AS w_start, least("end", greatest(start, least(start + w * 15, "end" - 30)) + 30) AS w_end FROM w)""")
def sliding_windows(spark, d):
    rows = timed(spark, d).select("event_id", "start", "end").where("end > start")
    out = I.sliding_windows(rows, 30.0, 15.0)
    return out.select("event_id", "w", *_ints(out, "w_start", "w_end"))


_SQL_RUNS = f"""{SQL_TIMED}, marked AS (SELECT *, event_type IN ('view', 'click') AS label, lag("end") OVER w AS before, lead(start) OVER w AS after,
 CASE WHEN lag(event_type IN ('view', 'click')) OVER w = (event_type IN ('view', 'click')) THEN 0 ELSE 1 END AS opens FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked)"""


@query(f"""WITH {_SQL_RUNS}, g AS (SELECT user_id, run, arg_min(label, (start, "end")) AS label, arg_min({{'s': start, 'b': before}}, (start, "end")) AS f, arg_max({{'e': "end", 'a': after}}, (start, "end")) AS l,
 count(*) AS n, avg(value) AS mean FROM r GROUP BY user_id, run)
SELECT user_id, run, label, n, cast(floor(greatest(f.s, (f.s + f.b) / 2) * 1000 + 0.5) AS bigint) AS start, cast(floor(least(l.e, (l.e + l.a) / 2) * 1000 + 0.5) AS bigint) AS "end",
 cast(floor(mean * 1000 + 0.5) AS bigint) AS mean FROM g""")
def window_runs_midpoint(spark, d):
    rows = timed(spark, d).withColumn("label", F.col("event_type").isin("view", "click"))
    runs = I.label_runs(rows, ["user_id"], "label", "value")
    return runs.select("user_id", "run", "label", "n", *_ints(runs, "start", "end", "mean"))


@query(f"""WITH {SQL_TIMED}, m AS (SELECT *, event_type <> 'error' AS target, CASE WHEN event_type <> 'error' AND lag(event_type <> 'error') OVER w AND start - lag("end") OVER w <= 21600 THEN 0 ELSE 1 END AS opens
 FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY start, "end")),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m)
SELECT user_id, run, {_sql_ms("start", "end")}, n FROM (SELECT user_id, run, min(start) AS start, max("end") AS "end", count(*) AS n FROM r WHERE target GROUP BY user_id, run)""")
def target_runs(spark, d):
    rows = timed(spark, d).withColumn("target", F.col("event_type") != "error")
    runs = I.target_runs(rows, ["user_id"], "target", 6 * HOUR)
    return runs.select("user_id", "run", *_ints(runs, "start", "end"), "n")


@query(f"""WITH {_SQL_ISLANDS}, p AS (SELECT user_id, start AS "at" FROM clicks UNION SELECT user_id, "end" FROM clicks),
n AS (SELECT user_id, "at", lead("at") OVER (PARTITION BY user_id ORDER BY "at") AS next FROM p)
SELECT user_id, count(*) AS pieces, cast(floor(sum(next - "at") + 0.5) AS bigint) AS span FROM n WHERE next IS NOT NULL GROUP BY user_id""")
def fragment_boundaries(spark, d):
    cut = I.boundary_pieces(_clicks(spark, d), ["user_id"])
    return cut.groupBy("user_id").agg(F.count(F.lit(1)).alias("pieces"), F.floor(F.sum(F.col("next") - F.col("at")) + 0.5).alias("span"))


@query(f"""WITH {SQL_TIMED}, o AS (SELECT *, CASE WHEN lag(start) OVER w IS NULL OR start - lag(start) OVER w >= 21600 THEN 1 ELSE 0 END AS opens FROM timed WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o)
SELECT user_id, island, count(*) AS n_units, min(event_id) AS first_event, {_sql_ms("start", "end")} FROM (SELECT user_id, island, event_id, min(start) OVER (PARTITION BY user_id, island) AS start, max("end") OVER (PARTITION BY user_id, island) AS "end" FROM i) GROUP BY user_id, island, start, "end" """)
def segments_by_pause(spark, d):
    rows = G.pause_islands(timed(spark, d), ["user_id"], "start", 6 * HOUR)
    found = rows.groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("n_units"), F.min("event_id").alias("first_event"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    return found.select("user_id", "island", "n_units", "first_event", *_ints(found, "start", "end"))


@query(f"""WITH {SQL_TIMED}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, round_even(start / 1800, 0), event_type ORDER BY start, event_id) AS n FROM timed)
SELECT user_id, event_type, count(*) AS kept, min(event_id) AS first_event FROM k WHERE n = 1 GROUP BY user_id, event_type""")
def unit_dedup(spark, d):
    rows = timed(spark, d).select("user_id", "event_type", "event_id", (F.col("start") / 180_000).alias("start"), F.col("event_type").alias("key"), F.col("start").alias("at"))
    kept = G.first_seen(rows, "user_id", ["at", "event_id"])
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first_event"))


@query(f"""WITH {SQL_TIMED}, e AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start, event_id) AS following FROM timed)
SELECT event_id, cast(floor((greatest(least("end", start + 0.4, CASE WHEN following > start THEN following ELSE "end" END), start + 0.08) - start) * 1000 + 0.5) AS bigint) AS lasting FROM e""")
def unit_end_estimate(spark, d):
    rows = timed(spark, d).withColumn("ord", F.col("event_id"))
    out = G.end_estimates(rows, ["user_id"])
    return out.select("event_id", F.floor((F.col("end") - F.col("start")) * 1000 + 0.5).alias("lasting"))


@query(f"""WITH {SQL_TIMED} SELECT event_id, cast(floor(greatest(0, value - 0.35) * 1000 + 0.5) AS bigint) AS clip_start, cast(floor(greatest(least(value + value / 10 + 0.65, 400), greatest(0, value - 0.35) + 0.1) * 1000 + 0.5) AS bigint) AS clip_end FROM timed""")
def clip_padding(spark, d):
    rows = timed(spark, d).select("event_id", "value")
    start, end = M.clip_start(F.col("value")), M.clip_end(F.col("value"), F.col("value") + F.col("value") / 10, F.lit(400.0))
    return rows.select("event_id", F.floor(start * 1000 + 0.5).alias("clip_start"), F.floor(end * 1000 + 0.5).alias("clip_end"))


@query("""WITH f AS (SELECT event_id, value, event_type, event_type = 'error' AS b1, value < 5 AS b2, value > 200 AS b3 FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN b1 THEN 'error' END, CASE WHEN b2 THEN 'short' END, CASE WHEN b3 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (b1 OR b2 OR b3) AS accepted FROM f""")
def gate_reasons(spark, d):
    rows = table(spark, d, "events")
    rules = [("error", F.col("event_type") == "error"), ("short", F.col("value") < 5), ("long", F.col("value") > 200)]
    found = rows.select("event_id", SA.all_failing(rules).alias("r"))
    return found.select("event_id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("accepted"))


@query("""WITH b AS (SELECT unnest([0, 10, 50, 100, 200]) AS lo, unnest([10, 50, 100, 200, 1000000]) AS hi)
SELECT lo, hi, count(value) AS n, count(DISTINCT user_id) AS users, cast(floor(coalesce(sum(value), 0) + 0.5) AS bigint) AS total FROM b LEFT JOIN events ON value >= lo AND value < hi GROUP BY lo, hi""")
def duration_buckets(spark, d):
    edges = [0, 10, 50, 100, 200, 1_000_000]
    pairs = list(zip(edges, edges[1:]))
    place = F.lit(None).cast("int")
    for lo, hi in pairs:
        place = F.when((F.col("value") >= lo) & (F.col("value") < hi), lo).otherwise(place)
    sums = table(spark, d, "events").withColumn("lo", place).groupBy("lo").agg(
        F.count("value").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("total")
    )
    all_buckets = spark.createDataFrame(pairs, "lo int, hi int")
    filled = F.broadcast(all_buckets).join(sums, "lo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return filled.select("lo", "hi", zero("n").alias("n"), zero("users").alias("users"), F.floor(zero("total") + 0.5).alias("total"))


_SQL_SPANS = """pred AS (SELECT user_id, event_id, start, "end", value FROM clicks WHERE event_type = 'view'), truth AS (SELECT user_id, start, "end" FROM clicks WHERE event_type IN ('click', 'purchase')),
ov AS (SELECT p.event_id, sum(least(p."end", t."end") - greatest(p.start, t.start)) AS shared FROM pred p JOIN truth t ON p.user_id = t.user_id AND p.start < t."end" AND t.start < p."end" GROUP BY p.event_id)"""


def _judged(spark, d):
    rows = _clicks(spark, d)
    predicted, truth = rows.where("event_type = 'view'"), rows.where("event_type in ('click', 'purchase')")
    pairs = I.overlap_join(predicted, truth, "user_id", 6 * HOUR)
    shared = pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(
        F.sum(I.overlap(*[F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")])).alias("shared")
    )
    return predicted.join(shared, "event_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))


@query(f"""WITH {_SQL_CLICKS}, {_SQL_SPANS}, j AS (SELECT p.user_id, p.value, p."end" - p.start AS lasting, coalesce(shared, 0) AS shared FROM pred p LEFT JOIN ov USING (event_id))
SELECT user_id, count(*) AS spans, count(*) FILTER (WHERE shared > 0.5 * lasting) AS right_spans, cast(floor(sum(shared) + 0.5) AS bigint) AS shared_s, cast(floor(sum(lasting) + 0.5) AS bigint) AS span_s FROM j GROUP BY user_id""")
def span_precision_recall(spark, d):
    lasting = F.col("end") - F.col("start")
    return _judged(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(F.col("shared") > 0.5 * lasting).alias("right_spans"),
        F.floor(F.sum("shared") + 0.5).alias("shared_s"), F.floor(F.sum(lasting) + 0.5).alias("span_s"),
    )


@query(f"""WITH {_SQL_CLICKS}, {_SQL_SPANS}, j AS (SELECT p.value, p."end" - p.start AS lasting, coalesce(shared, 0) AS shared FROM pred p LEFT JOIN ov USING (event_id)),
grid AS (SELECT * FROM (SELECT unnest([0, 10, 20, 40, 80]) AS least) CROSS JOIN (SELECT unnest([100, 200, 500]) AS most)),
s AS (SELECT least, most, count(*) FILTER (WHERE value BETWEEN least AND most) AS taken, count(*) FILTER (WHERE value BETWEEN least AND most AND shared > 0.5 * lasting) AS fine, count(*) FILTER (WHERE shared > 0.5 * lasting) AS all_fine FROM grid, j GROUP BY least, most)
SELECT least, most, taken, fine, all_fine, row_number() OVER (ORDER BY (CASE WHEN 5 * fine >= 2 * all_fine THEN 0 ELSE 1 END), fine / cast(greatest(taken, 1) AS double) DESC, fine DESC, least, most) = 1 AS chosen FROM s""")
def sweep_operating_point(spark, d):
    """One pass over the judged spans for the whole grid: a conditional count for each point."""
    grid = [(lo, hi) for lo in (0, 10, 20, 40, 80) for hi in (100, 200, 500)]
    fine = F.col("shared") > 0.5 * (F.col("end") - F.col("start"))
    within = lambda lo, hi: F.col("value").between(lo, hi)
    points = [F.struct(F.lit(lo).alias("least"), F.lit(hi).alias("most"), F.count_if(within(lo, hi)).alias("taken"), F.count_if(within(lo, hi) & fine).alias("fine")) for lo, hi in grid]
    found = _judged(spark, d).agg(F.count_if(fine).alias("all_fine"), F.array(*points).alias("points"))
    swept = found.select("all_fine", F.explode("points").alias("p")).select("p.*", "all_fine")
    order = Window.orderBy(
        F.when(5 * F.col("fine") >= 2 * F.col("all_fine"), 0).otherwise(1), F.desc(F.col("fine") / F.greatest("taken", F.lit(1))), F.desc("fine"), "least", "most"
    )
    return swept.withColumn("chosen", F.row_number().over(order) == 1)


@query("""SELECT event_type, count(value) AS n, round(min(value), 4) AS least, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75,
round(quantile_cont(value, 0.9), 4) AS p90, round(max(value), 4) AS most, round(avg(value), 3) AS mean FROM events GROUP BY event_type""")
def quantile_summary(spark, d):
    p = F.percentile("value", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    got = table(spark, d, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), p.alias("p"), F.max("value").alias("hi"), F.avg("value").alias("mean")
    )
    r = lambda c, k=4: F.round(c, k)
    return got.select(
        "event_type", "n", r(F.col("lo")).alias("least"), r(F.col("p")[0]).alias("p25"), r(F.col("p")[1]).alias("p50"),
        r(F.col("p")[2]).alias("p75"), r(F.col("p")[3]).alias("p90"), r(F.col("hi")).alias("most"), r(F.col("mean"), 3).alias("mean"),
    )


@query("""SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, count(*) FILTER (WHERE o_totalprice >= 100000) AS large, count(*) FILTER (WHERE o_totalprice >= 200000) AS larger,
count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderkey IS NULL) AS missing, cast(floor(quantile_cont(o_totalprice, 0.5) + 0.5) AS bigint) AS median FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def group_summary(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(
        F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_totalprice") >= 100_000).alias("large"),
        F.count_if(F.col("o_totalprice") >= 200_000).alias("larger"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"),
        F.count_if(F.col("o_orderkey").isNull()).alias("missing"), F.floor(F.percentile("o_totalprice", F.lit(0.5)) + 0.5).alias("median"),
    )


@query("""SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, max(n_chars) AS longest, grouping(lang) * 2 + grouping(source) AS level FROM documents GROUP BY GROUPING SETS ((), (lang), (source))""")
def grouping_sets_breakdown(spark, d):
    rows = table(spark, d, "documents").select("lang", "source", "n_chars")
    return rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.grouping_id().cast("bigint").alias("level")
    )


@query("""SELECT lang, source, count(*) AS n_docs, sum(n_chars) AS chars, grouping(lang) * 2 + grouping(source) AS level FROM documents GROUP BY ROLLUP (lang, source)""")
def rollup_channel_language(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("bigint").alias("level")
    )


@query("""WITH e AS (SELECT conv_id, turn AS ord, length(text) AS x, len(string_split(text, ' ')) AS y FROM conversations),
p AS (SELECT a.conv_id, sign(a.x - b.x) AS dx, sign(a.y - b.y) AS dy FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.ord < b.ord),
s AS (SELECT conv_id, count(*) FILTER (WHERE dx * dy > 0) AS concordant, count(*) FILTER (WHERE dx * dy < 0) AS discordant, count(*) FILTER (WHERE dx = 0) AS tied_x, count(*) FILTER (WHERE dy = 0) AS tied_y FROM p GROUP BY conv_id)
SELECT *, round(CASE WHEN (concordant + discordant + tied_x) * (concordant + discordant + tied_y) > 0 THEN (concordant - discordant) / sqrt(cast((concordant + discordant + tied_x) * (concordant + discordant + tied_y) AS double)) END, 6) AS tau FROM s""")
def kendall_tau_mod(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.length("text").alias("x"), F.size(F.split("text", " ")).alias("y"))
    return R.rank_correlation(rows, ["conv_id"], "x", "y").withColumn("tau", F.round("tau", 6))


@query("""WITH c AS (SELECT source, cast(sum(n_chars) AS double) AS s, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS k FROM documents GROUP BY source), m AS (SELECT count(*) AS m FROM c),
dr AS (SELECT round, unnest(range(1, m + 1)) AS i, m FROM (SELECT unnest(range(0, 50)) AS round), m),
h AS (SELECT round, cast('0x' || substring(sha256(concat_ws(':', '11', round, i)), 1, 8) AS bigint) % m AS k FROM dr)
SELECT round, cast(floor(sum(s) / sum(n) * 100 + 0.5) AS bigint) AS mean FROM h JOIN c USING (k) GROUP BY round""")
def bootstrap_ci(spark, d):
    means = R.bootstrap_means(table(spark, d, "documents").select("source", "n_chars"), "source", "n_chars", 50, "11")
    return means.select("round", F.floor(F.col("mean") * 100 + 0.5).alias("mean"))


@query("""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM conversations), p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM a)
SELECT conv_id, turn, levenshtein(before, text) AS errors, length(before) AS n_reference FROM p WHERE before IS NOT NULL""")
def cer_levenshtein(spark, d):
    over = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    rows = rows.withColumn("before", F.lag("text").over(over)).where("before is not null")
    return rows.select("conv_id", "turn", F.levenshtein("before", "text").alias("errors"), F.length("before").alias("n_reference"))


@query()
def wer_counts(spark, d):
    """Word edits of each turn against the one before; the counts come with merged chunks. SQL has no traceback."""
    from lexispan.functions import text as X

    over = Window.partitionBy("conv_id").orderBy("turn")
    words = table(spark, d, "conversations").select("conv_id", "turn", F.split(X.scoring_text(F.col("text")), " ").alias("hyp"))
    rows = words.withColumn("ref", F.lag("hyp").over(over)).where("ref is not null").select("conv_id", "turn", F.size("ref").alias("n_reference"), R.edits("ref", "hyp").alias("e"))
    rate = M.error_rate(F.col("e.substituted"), F.col("e.deleted"), F.col("e.inserted"), F.col("n_reference"))
    return rows.select("conv_id", "turn", "n_reference", "e.hits", "e.substituted", "e.deleted", "e.inserted", F.size("e.chunks").alias("n_chunks"), rate.alias("error_rate"))


_SQL_LINKS = """pred AS (SELECT DISTINCT l_suppkey % 20 AS c, l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_discount >= 0.05), sure AS (SELECT DISTINCT l_suppkey % 20 AS c, l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_returnflag = 'A'),
poss AS (SELECT DISTINCT l_suppkey % 20 AS c, l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_tax >= 0.04),
a AS (SELECT c, s, t, max(p) AS p, max(u) AS u, max(q) AS q FROM (SELECT *, 1 AS p, 0 AS u, 0 AS q FROM pred UNION ALL SELECT *, 0, 1, 1 FROM sure UNION ALL SELECT *, 0, 0, 1 FROM poss) GROUP BY c, s, t),
m AS (SELECT c AS "case", sum(p) AS predicted, sum(u) AS sure, sum(p * u) AS correct_sure, sum(p * q) AS correct_possible FROM a GROUP BY c)"""


def _links(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("case"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), "l_discount", "l_returnflag", "l_tax")
    return R.link_scores(rows.where("l_discount >= 0.05"), rows.where("l_returnflag = 'A'"), rows.where("l_tax >= 0.04"), "case")


@query(f"""WITH {_SQL_LINKS} SELECT "case", predicted, sure, correct_sure, correct_possible, round(correct_possible / cast(predicted AS double), 6) AS "precision", round(correct_sure / cast(sure AS double), 6) AS recall,
round(1 - (correct_sure + correct_possible) / cast(predicted + sure AS double), 6) AS aer FROM m""")
def alignment_prf_aer(spark, d):
    p, r, _ = R.precision_recall(F.col("correct_possible"), F.col("predicted"), F.col("correct_sure"), F.col("sure"))
    aer = R.alignment_error_rate(*[F.col(c) for c in ("correct_sure", "correct_possible", "predicted", "sure")])
    return _links(spark, d).select("case", "predicted", "sure", "correct_sure", "correct_possible", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(aer, 6).alias("aer"))


@query(f"""WITH {_SQL_LINKS} SELECT sum(predicted) AS predicted, sum(sure) AS sure, round(sum(correct_sure) / cast(sum(predicted) AS double), 6) AS micro_precision, round(sum(correct_sure) / cast(sum(sure) AS double), 6) AS micro_recall,
round(avg(correct_possible / cast(predicted AS double)), 5) AS macro_precision FROM m""")
def alignment_micro_macro(spark, d):
    s = lambda c: F.sum(c)
    return _links(spark, d).agg(
        s("predicted").alias("predicted"), s("sure").alias("sure"), F.round(s("correct_sure") / s("predicted"), 6).alias("micro_precision"),
        F.round(s("correct_sure") / s("sure"), 6).alias("micro_recall"), F.round(F.avg(F.col("correct_possible") / F.col("predicted")), 5).alias("macro_precision"),
    )


@query("""SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (WHERE n IS NULL) AS unlinked, coalesce(sum(n), 0) AS links FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY o_orderstatus""")
def exactly_once_accounting(spark, d):
    """Every order is linked or unlinked, never both: the linked come from the edges, the rest from the missing side."""
    edges = table(spark, d, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(edges, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("n").isNull()).alias("unlinked"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")
    )


@query("""SELECT o_orderkey, o_custkey, sha256('s1:' || cast(o_orderkey AS varchar)) AS draw FROM orders ORDER BY draw LIMIT 200""")
def hash_order_sample(spark, d):
    return SA.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "s1", 200)


@query("""SELECT o_custkey, o_orderkey, round FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS round FROM orders) ORDER BY round, o_custkey LIMIT 500""")
def round_robin_sample(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return SA.round_robin(rows, "o_custkey", ["o_orderdate", "o_orderkey"], 500).select("o_custkey", "o_orderkey", "round")


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority, cast(floor(o_totalprice / 100000) AS bigint) AS bin FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY sha256('s2:' || cast(o_orderkey AS varchar)), o_orderkey) AS place FROM s) SELECT o_orderpriority, bin, o_orderkey, place FROM n WHERE place <= 5""")
def stratified_bins(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 100_000).alias("bin"), "o_orderkey")
    return SA.per_cell(rows, ["o_orderpriority", "bin"], "o_orderkey", "s2", 5)


@query()
def greedy_gap_sample(spark, d):
    """In seeded order the events of each user that keep six hours' distance; what is taken depends on all before it."""
    return SA.spaced(_clicks(spark, d), "user_id", "event_id", "s3", 6 * HOUR, 20)


@query()
def capped_chunks(spark, d):
    """Islands of each user joined over gaps of ten minutes while a chunk stays under twelve hours: a greedy fold."""
    return I.capped_merge(I.islands(_clicks(spark, d), ["user_id"]), "user_id", 600.0, 12 * HOUR)


@query()
def viterbi_smooth(spark, d):
    """Two-state smoothing of each user's events in order; SQL would need a recursive query."""
    rows = timed(spark, d).select("user_id", F.col("event_id").alias("ord"), (F.col("value") / (F.col("value") + 50)).alias("p"))
    return I.viterbi(rows, "user_id", "p", 1.5)


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, max(o_totalprice) AS top FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_name""")
def channel_left_join_stats(spark, d):
    n, c = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return joined.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.max("o_totalprice").alias("top"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT coalesce(c.k, s.k) AS nationkey, c.k IS NOT NULL AS configured, coalesce(s.n, 0) AS indexed FROM c FULL OUTER JOIN s ON c.k = s.k""")
def configured_vs_indexed_full_outer(spark, d):
    configured = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).distinct().withColumn("c", F.lit(True))
    indexed = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    both = configured.join(indexed, "nationkey", "full_outer")
    return both.select("nationkey", F.coalesce("c", F.lit(False)).alias("configured"), F.coalesce("n", F.lit(0)).alias("indexed"))


@query("""WITH x AS (SELECT 'en' AS lang, 'src3' AS source UNION ALL SELECT 'de', 'src5' UNION ALL SELECT 'fr', 'src7') SELECT lang, count(*) AS kept, sum(n_chars) AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = d.lang AND x.source = d.source) GROUP BY lang""")
def disabled_channel_anti_join(spark, d):
    disabled = spark.createDataFrame([("en", "src3"), ("de", "src5"), ("fr", "src7")], "lang string, source string")
    docs = table(spark, d, "documents").select("lang", "source", "n_chars")
    return docs.join(F.broadcast(disabled), ["lang", "source"], "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_chars").alias("chars"))


@query("""SELECT source, count(*) FILTER (WHERE coalesce(toxic = 0, true)) AS playable, count(*) FILTER (WHERE toxic IS NULL) AS unknown, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def embeddable_null_filter(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count_if(F.coalesce(F.col("toxic") == 0, F.lit(True))).alias("playable"), F.count_if(F.col("toxic").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n")
    )


_SQL_CACHE = """old AS (SELECT o_custkey AS k, min(o_orderkey) AS v, min(o_orderdate) AS created FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY o_custkey), new AS (SELECT o_custkey AS k, max(o_orderkey) AS v, max(o_orderdate) AS created FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_custkey)"""


def _cache(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    old = o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).groupBy("k").agg(F.min("o_orderkey").alias("v"), F.min("o_orderdate").alias("created"))
    new = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).groupBy("k").agg(F.max("o_orderkey").alias("v"), F.max("o_orderdate").alias("created"))
    return old, new


@query(f"WITH {_SQL_CACHE} SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)")
def cache_replace(spark, d):
    old, new = _cache(spark, d)
    return C.replaced(old, new, ["k"]).select("k", "v")


@query(f"WITH {_SQL_CACHE} SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, strftime(coalesce(o.created, n.created), '%Y-%m-%d') AS created FROM old o FULL OUTER JOIN new n ON o.k = n.k")
def cache_upsert_merge(spark, d):
    old, new = _cache(spark, d)
    return C.merged(old, new, ["k"], ["created"]).withColumn("created", F.date_format("created", "yyyy-MM-dd"))


@query(f"WITH {_SQL_CACHE} SELECT count(*) AS requests, count(o.k) AS hits, count(*) - count(o.k) AS misses FROM new n LEFT JOIN old o ON n.k = o.k")
def cache_hit_stats(spark, d):
    old, new = _cache(spark, d)
    found = C.looked_up(new.select("k"), old, ["k"])
    return found.agg(F.count(F.lit(1)).alias("requests"), F.sum("hit").alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def newest_alignment(spark, d):
    return C.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS partial, count(*) AS total FROM orders GROUP BY o_orderpriority""")
def job_state_counts(spark, d):
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(state("O").alias("open"), state("F").alias("done"), state("P").alias("partial"), F.count(F.lit(1)).alias("total"))


@query("""SELECT 'documents' AS kind, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY event_type""")
def status_union_counts(spark, d):
    part = lambda t, c: table(spark, d, t).groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("kind"), "name", "n")
    return part("documents", "lang").unionByName(part("conversations", "role")).unionByName(part("events", "event_type"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, abs(cast(unnest(embedding) AS double)) AS p FROM embeddings),
c AS (SELECT vec_id, CASE k % 6 WHEN 0 THEN 'es' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'es' WHEN 4 THEN 'zh' ELSE 'ca' END AS code, p FROM e)
SELECT vec_id, cast(floor(sum(p) FILTER (WHERE code = 'es') * 10000 + 0.5) AS bigint) AS own, cast(floor(sum(p) FILTER (WHERE code = 'es') / sum(p) FILTER (WHERE code IN ('es', 'en', 'zh')) * 10000 + 0.5) AS bigint) AS closed,
cast(floor(sum(p) FILTER (WHERE code = 'es') / (sum(p) FILTER (WHERE code = 'es') + max(p) FILTER (WHERE code <> 'es')) * 10000 + 0.5) AS bigint) AS pairwise FROM c GROUP BY vec_id""")
def closed_set_probability(spark, d):
    """Sizes of a vector's entries taken for the probabilities of six kinds of labels, two of them of one language."""
    codes = F.array(*(F.lit(c) for c in ("es: Spanish", "en", "fr_CA", "ES-mx", "zh-Hans", "ca")))
    labelled = F.transform("embedding", lambda x, i: F.struct(F.get(codes, i % 6).alias("code"), F.abs(x.cast("double")).alias("p")))
    rows = table(spark, d, "embeddings").select("vec_id", labelled.alias("dist"))
    own = M.probability_of(F.col("dist"), F.lit("es"))
    closed, pair = M.closed_set_probability(F.col("dist"), F.lit("es"), ["es", "en", "zh-CN"]), M.pairwise_probability(F.col("dist"), own, F.lit("es"))
    return rows.select("vec_id", *(F.floor(c * 10000 + 0.5).alias(n) for c, n in ((own, "own"), (closed, "closed"), (pair, "pairwise"))))


@query("""SELECT user_id, cast(floor(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / nullif(sum(value), 0) * 1000000 + 0.5) AS bigint) AS pooled, count(*) AS n FROM events GROUP BY user_id""")
def pooled_ratio(spark, d):
    top = F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0))
    return table(spark, d, "events").groupBy("user_id").agg(F.floor(M.ratio(top, F.sum("value")) * 1_000_000 + 0.5).alias("pooled"), F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM e WHERE list_contains(list_transform(range(0, 5), lambda i: cast(round_even(i * (n - 1) / 4.0, 0) AS bigint)), p)""")
def evenly_spaced_sample(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    return SA.evenly_spaced(rows, ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query("""SELECT l.lang, a.name AS analyzer, CASE WHEN l.lang IN ('en', 'es') THEN cast(l.n AS varchar) ELSE 'N/A' END AS result FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) l CROSS JOIN (SELECT unnest(['unicode', 'lexicon']) AS name) a""")
def result_matrix(spark, d):
    """The few languages times the few analyzers, with explicit gaps."""
    langs = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    out = langs.select("lang", "n", F.explode(F.array(F.lit("unicode"), F.lit("lexicon"))).alias("analyzer"))
    return out.select("lang", "analyzer", F.when(F.col("lang").isin("en", "es"), F.col("n").cast("string")).otherwise("N/A").alias("result"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END), o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM o WHERE r = 1""")
def preferred_track(spark, d):
    """The best of several candidates by a lexicographic key: authored first, then kind, then size."""
    key = F.struct(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), "o_orderpriority", -F.col("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("o_orderkey"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(html), 'removed|private|not found') THEN 'permanent' WHEN regexp_matches(lower(html), 'timeout|too many|429|503') THEN 'temporary' ELSE 'none' END AS failure,
left(regexp_replace(url, 'https?://\S+', '<url>', 'g'), 300) AS message FROM pages""")
def failure_classes(spark, d):
    from lexispan.functions.text import sanitized

    low = F.lower("html")
    kind = F.when(low.rlike("removed|private|not found"), "permanent").when(low.rlike("timeout|too many|429|503"), "temporary").otherwise("none")
    return table(spark, d, "pages").select("page_id", kind.alias("failure"), sanitized(F.col("url")).alias("message"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), c AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)
SELECT 'only_suppliers' AS side, count(*) AS n FROM s WHERE s_nationkey NOT IN (SELECT c_nationkey FROM c) UNION ALL SELECT 'both', count(*) FROM s WHERE s_nationkey IN (SELECT c_nationkey FROM c)
UNION ALL SELECT 'only_customers', count(*) FROM c WHERE c_nationkey NOT IN (SELECT s_nationkey FROM s)""")
def set_difference_parity(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return count(s.join(c, "k", "left_anti"), "only_suppliers").unionByName(count(s.join(c, "k", "left_semi"), "both")).unionByName(count(c.join(s, "k", "left_anti"), "only_customers"))


@query("""SELECT conv_id, string_agg(role || ':' || cast(length(text) AS varchar), ' ' ORDER BY turn) AS shape, count(*) AS turns FROM conversations GROUP BY conv_id""")
def ordered_concatenation(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("p"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["p"]), " ").alias("shape"), F.count(F.lit(1)).alias("turns"))


@query("""WITH e AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(len(string_split(text, ' '))) OVER (PARTITION BY conv_id) AS whole FROM conversations)
SELECT conv_id, turn, cast(floor((upto - n) / cast(whole AS double) * 60000 + 0.5) AS bigint) AS start_ms FROM e""")
def cue_interpolation(spark, d):
    """Start times by each part's share of the words, over a minute for a conversation."""
    n = F.size(F.split("text", " "))
    rows = table(spark, d, "conversations").select("conv_id", "turn", n.alias("n"))
    over = Window.partitionBy("conv_id")
    upto = F.sum("n").over(over.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("n").over(over)
    return rows.select("conv_id", "turn", F.floor((upto - F.col("n")) / whole * 60000 + 0.5).alias("start_ms"))


@query("""SELECT sha256('x' || chr(0) || cast(event_id AS varchar)) AS event_key, event_id FROM events""")
def content_keys(spark, d):
    return table(spark, d, "events").select(ids.digest(F.lit("x"), F.col("event_id")).alias("event_key"), "event_id")
