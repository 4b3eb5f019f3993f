"""Registered queries against their SQL in DuckDB, and closed forms against plain loops."""

import random

import duckdb
import pytest

from lexispan.operators import search as S
from lexispan.operators import tokens as K
from lexispan.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(bool(v))
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return f"{x:.6g}" if x != int(x) else str(int(x))


def rows_of(pdf):
    return sorted(tuple(told(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    assert len(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_round_robin_equals_passes(spark):
    draw = random.Random(1)
    rows = [(draw.randint(0, 1), f"v{draw.randint(0, 6)}", draw.randint(0, 50), i) for i in range(80)]
    df = spark.createDataFrame(rows, "tier int, video string, score int, id int")
    from pyspark.sql import functions as F

    page = S.diversified(df, "tier", "video", [F.desc("score"), "id"], 30).orderBy("rank").collect()
    want = []
    for tier in (0, 1):
        left = sorted((r for r in rows if r[0] == tier), key=lambda r: (-r[2], r[3]))
        allowed = 1
        while left:
            used, rest = {}, []
            for r in left:
                taken = sum(1 for w in want if w[0] == tier and w[1] == r[1])
                if taken < allowed and not used.get(r[1]):
                    want.append(r)
                    used[r[1]] = True
                else:
                    rest.append(r)
            left, allowed = rest, allowed + 1
    assert [p["id"] for p in page] == [w[3] for w in want[:30]]


def test_phrase_joins_equal_windows(spark):
    draw = random.Random(2)
    rows = [(s, p, draw.choice("abc")) for s in range(20) for p in range(30)]
    tokens = spark.createDataFrame(rows, "seg int, pos int, tok string")
    phrases = {"ab": ["a", "b"], "aba": ["a", "b", "a"], "c": ["c"]}
    windowed = {(r["seg"], r["pos"], r["phrase"]) for r in K.phrase_matches_windowed(tokens, ["seg"], phrases).collect()}
    joined = {(r["seg"], r["pos"], n) for n, ws in phrases.items() for r in K.phrase_matches(tokens, ["seg"], [[w] for w in ws]).collect()}
    assert windowed == joined and windowed


def test_holes_stop_phrases(spark):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 2, "b")], "seg int, pos int, tok string")
    assert K.phrase_matches(tokens, ["seg"], [["a"], ["b"]]).count() == 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_index_queries_publish_what_they_read(spark, monkeypatch):
    """Phrases need the positions only, which are written as the texts lie; counts of words need no n-grams."""
    import os

    from lexispan.plans import index_queries as Q

    def built():
        ((root, _),) = Q._built.values()
        return sorted(os.listdir(root))

    monkeypatch.setattr(Q, "_built", {})
    registry.QUERIES["phrase_exact_of_the"](spark, SF)
    assert built() == ["stream_tokens"]
    for name in ("indexed_phrase_hits", "indexed_phrase_batch"):
        registry.QUERIES[name](spark, SF)
    assert built() == ["stream_tokens"]
    registry.QUERIES["token_counts_by_lang"](spark, SF)
    assert built() == ["segments", "stream_tokens", "word_counts"]
    plan = Q.tokens_of(Q.listed(spark.read.parquet(f"{SF}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["span_agreement_scores", "lemma_retrieval_scores"])
def test_shared_and_absent_ids_equal_sql(spark, tmp_path, name):
    """Lines of documents that share an id meet at their places, those without an id or a language don't; all others are counted in their rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.where("doc_id < 12").withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id") % 5)).withColumn("lang", F.when(F.col("doc_id") == 4, None).otherwise(F.col("lang")))
    if name == "lemma_retrieval_scores":
        odd = odd.where("doc_id is not null")  # its SQL gathers the places of all documents without an id
    docs.where("doc_id >= 12 and doc_id < 60").unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert rows_of(got) == rows_of(want)
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # tokens aren't shuffled by their place: agreement needs no join, retrieval counts words first
    assert "FullOuter" not in plan if name == "span_agreement_scores" else "Exchange hashpartitioning(tok#" in plan
