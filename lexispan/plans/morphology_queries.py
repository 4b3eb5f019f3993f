"""Queries that score analyses and lemma retrieval. The tables have no lemmas: a form without its final s stands for one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.operators import morphology as MO
from lexispan.operators import tokens as K
from lexispan.plans.tables import SQL_STREAM, by_identity, query, sql_tokens, table

_STRICT = "nullif(nullif(replace(lower(nfc_normalize({0})), 'ß', 'ss'), ''), '_')"
_UPOS = "CASE length({0}) % 5 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN NULL WHEN 3 THEN 'ADJ' ELSE 'PUNCT' END"


def _lemma(form):
    return F.rtrim(form, F.lit("s"))


def _words(spark, d):
    """Gold words of turns, two of them at a place, and a plain split's words."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    form, size = F.col("form"), F.length("form") % 5
    gold = rows.select("conv_id", "turn", F.posexplode(X.normalized_tokens(F.col("text"))).alias("ord", "form"))
    upos = F.when(size == 0, "NOUN").when(size == 1, "VERB").when(size == 3, "ADJ").when(size == 4, "PUNCT")
    own = rows.select("conv_id", "turn", F.posexplode(F.filter(F.split(F.lower("text"), " "), lambda w: w != "")).alias("ord", "form"))
    placed = lambda df: df.withColumn("start", F.expr("ord div 2")).withColumn("end", F.expr("ord div 2 + 1"))
    return placed(gold.withColumns({"lemma": _lemma(form), "upos": upos})), placed(own.withColumn("lemma", F.when(F.length("form") > 3, _lemma(form))))


def _lexicon(spark, d):
    forms = table(spark, d, "benchmark").select(F.explode(X.normalized_tokens(F.col("text"))).alias("form"))
    return forms.select("form", F.explode(F.array(_lemma(F.col("form")), F.col("form"))).alias("lemma"), F.lit("X").alias("upos")).distinct()


_SQL_WORDS = f"""g0 AS (SELECT conv_id, turn, generate_subscripts(t, 1) - 1 AS ord, unnest(t) AS form FROM (SELECT conv_id, turn, {sql_tokens('text')} AS t FROM conversations)),
g AS (SELECT *, ord // 2 AS start, rtrim(form, 's') AS lemma, row_number() OVER (PARTITION BY conv_id, turn, ord // 2 ORDER BY ord) AS k FROM (SELECT *, {_UPOS.format('form')} AS upos FROM g0) WHERE upos IS NULL OR upos <> 'PUNCT'),
p AS (SELECT *, ord // 2 AS start, CASE WHEN length(form) > 3 THEN rtrim(form, 's') END AS lemma, row_number() OVER (PARTITION BY conv_id, turn, ord // 2 ORDER BY ord) AS k
 FROM (SELECT conv_id, turn, generate_subscripts(t, 1) - 1 AS ord, unnest(t) AS form FROM (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS t FROM conversations))),
lx AS (SELECT DISTINCT form, lemma FROM (SELECT form, unnest([rtrim(form, 's'), form]) AS lemma FROM (SELECT unnest({sql_tokens('text')}) AS form FROM benchmark)))"""


@query(f"""WITH {_SQL_WORDS}, kn AS (SELECT {_STRICT.format('form')} AS strict, count(*) AS analyses FROM (SELECT DISTINCT * FROM lx) GROUP BY ALL),
j AS (SELECT coalesce(g.upos, 'NULL') AS upos, p.conv_id IS NOT NULL AS met, {_STRICT.format('p.lemma')} AS got, {_STRICT.format('g.lemma')} AS want, analyses FROM g LEFT JOIN p USING (conv_id, turn, start, k) LEFT JOIN kn ON kn.strict = {_STRICT.format('g.form')}),
f AS (SELECT *, met AND got IS NOT NULL AS told, met AND got IS NOT NULL AND got IS NOT DISTINCT FROM want AS ok, analyses IS NULL AS unseen, coalesce(analyses > 1, false) AS several FROM j)
SELECT upos, count(*) AS gold, count(*) FILTER (WHERE met) AS aligned, count(*) FILTER (WHERE told) AS predicted, count(*) FILTER (WHERE ok) AS strict_correct, count(*) FILTER (WHERE unseen) AS unseen_gold, count(*) FILTER (WHERE unseen AND told) AS unseen_predicted,
count(*) FILTER (WHERE unseen AND ok) AS unseen_correct, count(*) FILTER (WHERE several) AS ambiguous_gold, count(*) FILTER (WHERE several AND told) AS ambiguous_predicted, count(*) FILTER (WHERE several AND ok) AS ambiguous_correct,
count(*) FILTER (WHERE met AND NOT told) AS missing_lemma, count(*) FILTER (WHERE told AND NOT ok) AS wrong_lemma, count(*) FILTER (WHERE NOT met) AS unaligned FROM f GROUP BY GROUPING SETS ((), (upos))""")
def analysis_scores(spark, d):
    gold, own = _words(spark, d)
    outcomes = MO.word_outcomes(gold, own, _lexicon(spark, d), ["conv_id", "turn"])
    return MO.outcome_counts(outcomes).drop("production_correct")


@query(f"""WITH {_SQL_WORDS}, a AS (SELECT conv_id, turn, start, list({_STRICT.format('form')} ORDER BY ord) AS f FROM g GROUP BY ALL), b AS (SELECT conv_id, turn, start, list({_STRICT.format('form')} ORDER BY ord) AS f FROM p GROUP BY ALL)
SELECT count(a.f) AS gold_boundaries, count(b.f) AS predicted_boundaries, count(*) FILTER (WHERE a.f IS NOT NULL AND b.f IS NOT NULL) AS correct_boundaries, count(*) FILTER (WHERE len(a.f) > 1) AS gold_mwt, count(*) FILTER (WHERE len(a.f) > 1 AND a.f = b.f) AS correct_mwt,
sum(CASE WHEN a.f IS NOT NULL THEN abs(len(a.f) - coalesce(len(b.f), 0)) + greatest(len(a.f) - coalesce(len(b.f), 0), 0) ELSE 0 END) AS tokenization_mismatch FROM a FULL OUTER JOIN b USING (conv_id, turn, start)""")
def analysis_boundaries(spark, d):
    gold, own = _words(spark, d)
    return MO.boundary_scores(gold, own, ["conv_id", "turn"]).drop("precision", "recall", "f1")


@query(f"""WITH {SQL_STREAM}, s AS (SELECT doc_id, seg, pos, tok, CASE WHEN length(tok) > 3 THEN rtrim(tok, 's') END AS lemma FROM tok),
q AS (SELECT item_id AS query_id, t[1] AS surface, rtrim(t[1], 's') AS intended, CASE WHEN item_id % 2 = 0 THEN 'ambiguous_form' ELSE 'inflected' END AS kind FROM (SELECT item_id, {sql_tokens('text')} AS t FROM benchmark) WHERE len(t) > 0),
lx AS (SELECT DISTINCT form, lemma FROM (SELECT form, unnest([rtrim(form, 's'), form]) AS lemma FROM (SELECT unnest({sql_tokens('text')}) AS form FROM benchmark)) WHERE lemma <> ''),
h AS (SELECT query_id, doc_id, seg, pos, true AS x, false AS l, false AS g FROM q JOIN s ON s.tok = q.surface UNION ALL SELECT query_id, doc_id, seg, pos, false, true, false FROM (SELECT DISTINCT query_id, lemma FROM q JOIN lx ON lx.form = q.surface) JOIN s USING (lemma)
 UNION ALL SELECT query_id, doc_id, seg, pos, false, false, true FROM q JOIN s ON rtrim(s.tok, 's') = q.intended WHERE q.intended <> ''),
o AS (SELECT query_id, doc_id, seg, pos, bool_or(x) AS x, bool_or(l) AS l, bool_or(g) AS g FROM h GROUP BY ALL),
c AS (SELECT query_id, count(*) FILTER (WHERE x) AS exact_count, count(*) FILTER (WHERE l) AS lemma_count, count(*) FILTER (WHERE x OR l) AS auto_count, count(*) FILTER (WHERE l AND NOT x) AS deduplicated_expansion, count(*) FILTER (WHERE g) AS gold,
 count(*) FILTER (WHERE l AND g) AS lg, count(*) FILTER (WHERE (x OR l) AND g) AS ag FROM o GROUP BY query_id)
SELECT query_id, coalesce(exact_count, 0) AS exact_count, coalesce(lemma_count, 0) AS lemma_count, coalesce(auto_count, 0) AS auto_count, coalesce(deduplicated_expansion, 0) AS deduplicated_expansion,
coalesce(cast(floor(lg * 1000 / cast(nullif(gold, 0) AS double) + 0.5) AS bigint), -1) AS recall, coalesce(cast(floor(lg * 1000 / cast(nullif(lemma_count, 0) AS double) + 0.5) AS bigint), -1) AS precision,
coalesce(cast(floor(CASE WHEN kind = 'ambiguous_form' THEN ag * 1000 / cast(nullif(auto_count, 0) AS double) END + 0.5) AS bigint), -1) AS union_precision FROM q LEFT JOIN c USING (query_id)""")
def lemma_retrieval_scores(spark, d):
    """The first words of the benchmark items sought by form and by lemma in all documents; per mille, -1 where there is nothing to divide by."""
    first = F.element_at(X.normalized_tokens(F.col("text")), 1)
    rows = table(spark, d, "benchmark").where(F.size(X.normalized_tokens(F.col("text"))) > 0).select(F.col("item_id").alias("query_id"), first.alias("surface"))
    kind = F.when(F.col("query_id") % 2 == 0, "ambiguous_form").otherwise("inflected")
    queries = rows.select("query_id", "surface", _lemma(F.col("surface")).alias("intended_lemma"), kind.alias("selection_class"))
    place = ["doc_id", "seg", "pos", "type", "n"]
    alone, shared = by_identity(table(spark, d, "documents"), ["doc_id"])
    stream = lambda docs: K.stream(K.segments(docs), ["doc_id", "seg"])
    # routes and gold depend on the word only, so its occurrences are counted first
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("seg", "int"), ("pos", "int"))]
    tokens = stream(alone).groupBy("tok").agg(F.count(F.lit(1)).alias("n")).select(*none, F.col("tok").alias("type"), "n", "tok")
    if shared is not None:  # at a place of several rows there are several words
        tokens = tokens.unionByName(stream(shared).select("doc_id", "seg", "pos", F.lit(None).cast("string").alias("type"), F.lit(1).cast("bigint").alias("n"), "tok"))
    lemma = F.when(F.length("tok") > 3, _lemma(F.col("tok")))
    routes = F.array(F.struct(F.lit("exact").alias("route"), F.col("tok").alias("key")), F.struct(F.lit("lemma").alias("route"), lemma.alias("key")))
    streams = tokens.select(*place, F.inline(routes)).where("key is not null")
    keys = MO.query_keys(queries, _lexicon(spark, d))
    gold = tokens.select(_lemma(F.col("tok")).alias("lemma"), *place)
    found = MO.retrieval_scores(queries, keys, streams, gold, place, "n")
    whole = lambda c, n: F.coalesce(F.floor(F.round(F.col(c) * 1000, 3) + 0.5), F.lit(-1)).alias(n)
    return found.select(
        "query_id", "exact_count", "lemma_count", "auto_count", "deduplicated_expansion", whole("candidate_lemma_recall", "recall"), whole("intended_lemma_precision", "precision"),
        whole("ambiguous_union_precision", "union_precision"),
    )
