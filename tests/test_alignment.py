import pytest
from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.operators import alignment as A


def test_overlapping_groups_merge_pair_by_pair(spark):
    rows = [([(0, 4, 1.0, 2.0, 0.8), (2, 6, 0.5, 1.5, 0.4), (5, 7, 2.0, 3.0, 0.2), (7, 9, 3.0, 4.0, 1.0)],), ([],)]
    df = spark.createDataFrame(rows, "g array<struct<char_start:int,char_end:int,start:double,end:double,confidence:double>>")
    out = [[tuple(x) for x in r["m"]] for r in df.select(A.merged_overlaps(F.col("g")).alias("m")).collect()]
    assert out[0] == [(0, 7, 0.5, 3.0, pytest.approx((0.6 + 0.2) / 2)), (7, 9, 3.0, 4.0, 1.0)] and out[1] == []


def test_gaps_make_a_cover(spark):
    df = spark.createDataFrame([("a", 2, 4), ("a", 4, 6), ("a", 8, 9)], "k string, char_start int, char_end int")
    full = A.with_gaps(df, ["k"], F.lit(12))
    assert [(r["char_start"], r["char_end"], r["timed"]) for r in full.orderBy("char_start").collect()] == [
        (0, 2, False), (2, 4, True), (4, 6, True), (6, 8, False), (8, 9, True), (9, 12, False),
    ]
    assert A.cover_problems(full.drop("timed"), ["k"], F.lit(12)).count() == 0
    assert [r["problem"] for r in A.cover_problems(df, ["k"], F.lit(12)).collect()] == ["gap or overlap"] * 2
    short = spark.createDataFrame([("a", 0, 4), ("a", 4, 6)], "k string, char_start int, char_end int")
    assert [r["problem"] for r in A.cover_problems(short, ["k"], F.lit(12)).collect()] == ["not to the end"]


def test_token_problems(spark):
    rows = [(1, 0, "ab", 0, 2, False), (1, 1, "b", 1, 2, False), (1, 2, "x", 3, 4, False), (1, 3, "cd", 3, 9, False)]
    df = spark.createDataFrame(rows, "k int, pos int, surface string, char_start int, char_end int, shared_span boolean").withColumn("text", F.lit("ab cd"))
    found = {r["pos"]: r["problem"] for r in A.token_problems(df, ["k"], F.col("text")).collect()}
    assert found == {1: "overlap", 2: "unlike the text", 3: "out of bounds"}


def test_a_prune_needs_a_selector(spark):
    files = spark.createDataFrame([(1, "es"), (2, "es"), (3, "de")], "id int, language string")
    with pytest.raises(ValueError):
        A.pruned(files, files.limit(0), ["id"], [])
    assert [r["id"] for r in A.pruned(files, files.where("id = 1"), ["id"], [F.col("language") == "es"]).collect()] == [2]


def test_proxy_label_ties_go_to_the_target(spark):
    df = spark.createDataFrame([(1, "other", 2.0), (1, "target", 2.0), (2, "mixed", 3.0), (2, "target", 1.0)], "u int, kind string, seconds double")
    assert {r["u"]: r["label"] for r in A.proxy_labels(df, "u").collect()} == {1: "target", 2: "mixed"}


def test_offsets_in_rows_have_the_problems_of_tokens(spark):
    texts = ["a cat, a cat", "", "naïve ’tis it's 12", "ab ab ab"]
    found = [A.problem_count(t, w) for t, w in ((texts[0], ["a", "cat", "a", "cat"]), (texts[2], ["naïve", "tis", "it's", "12"]), (texts[3], ["ab", "zz", "ab"]), ("ab", ["ab", "ab"]))]
    assert found == [0, 0, 1, 1]
    lists = [["a", "cat", "cat", "a"], [], ["it's", "naïve", "12"], ["ab", "b", "zz", "ab"]]
    rows = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(zip(texts, lists))], "id int, text string, words array<string>")
    spans = rows.select("id", "text", F.posexplode(X.token_spans(F.col("text"), F.col("words"))).alias("pos", "s"))
    tokens = spans.select("id", "text", "pos", "s.surface", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.lit(False).alias("shared_span"))
    old = {r["id"]: r["count"] for r in A.token_problems(tokens, ["id"], F.col("text")).where("problem != 'overlap'").groupBy("id").count().collect()}
    got = {r["id"]: r["c"]["problems"] for r in rows.select("id", A.offset_problems("text", "words").alias("c")).collect()}
    assert got == {i: old.get(i, 0) for i in range(4)}
