import pytest
from pyspark.sql import functions as F

from lexispan.functions import measures as M
from lexispan.operators import sampling as SA
from lexispan.operators import scoring as R


@pytest.mark.parametrize(
    "reference, hypothesis, counts",
    [
        ("a b c", "a b c", (3, 0, 0, 0)),
        ("a b c", "a x c", (2, 1, 0, 0)),
        ("a b c", "a c", (2, 0, 1, 0)),
        ("a c", "a b c", (2, 0, 0, 1)),
        ("", "a b", (0, 0, 0, 2)),
        ("a b", "", (0, 0, 2, 0)),
    ],
)
def test_edit_counts(reference, hypothesis, counts):
    e = R.edit_script(reference.split(), hypothesis.split())
    assert (e["hits"], e["substituted"], e["deleted"], e["inserted"]) == counts
    assert sum(c["ref_end"] - c["ref_start"] for c in e["chunks"]) == len(reference.split())


def test_edits_equal_a_plain_matrix():
    """Counts, chunks that cover both sides, and the order of preference, over random texts of few words."""
    import random

    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(0, 12))] for _ in range(2))
        cost = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                cost[i][j] = max(i, j) if not i or not j else min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        e = R.edit_script(a, b)
        assert e["substituted"] + e["deleted"] + e["inserted"] == cost[-1][-1]
        i = j = 0
        for k, c in enumerate(e["chunks"]):
            assert (c["ref_start"], c["hyp_start"]) == (i, j) and (not k or c["op"] != e["chunks"][k - 1]["op"])
            i, j = c["ref_end"], c["hyp_end"]
            same = a[c["ref_start"] : i] == b[c["hyp_start"] : j]
            assert same if c["op"] == "equal" else not same
        assert (i, j) == (len(a), len(b))


def test_order_of_preference():
    ops = lambda a, b: [(c["op"], c["ref_end"], c["hyp_end"]) for c in R.edit_script(a.split(), b.split())["chunks"]]
    assert ops("a b", "b") == [("delete", 1, 0), ("equal", 2, 1)]
    assert ops("a a", "a") == [("delete", 1, 0), ("equal", 2, 1)]
    assert ops("x y", "z") == [("delete", 1, 0), ("substitute", 2, 1)]
    assert ops("a", "x y") == [("insert", 0, 1), ("substitute", 1, 2)]
    assert ops("the cat sat", "the cat sat") == [("equal", 3, 3)]
    assert ops("", "") == []


def test_long_edits_in_bounded_memory():
    a = [str(k % 97) for k in range(3000)]
    b = [w for k, w in enumerate(a) if k % 50] + ["end"]
    e = R.edit_script(a, b)
    assert (e["deleted"] + e["inserted"] + e["substituted"]) <= 61 and e["hits"] >= 2939


def test_error_rates(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 2, 0), (1, 1, 3, 2)], "s int, d int, i int, n int")
    rates = df.select(M.error_rate(F.col("s"), F.col("d"), F.col("i"), F.col("n")).alias("r")).collect()
    assert [r["r"] for r in rates] == [0.0, None, 2.5]


def test_edits_column_and_blocks(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], ["x"])], "r array<string>, h array<string>")
    out = df.select(R.edits("r", "h").alias("e"), R.matching_blocks("r", "h").alias("b")).collect()
    assert [(r["e"]["hits"], r["e"]["substituted"], r["e"]["inserted"]) for r in out] == [(1, 1, 0), (0, 0, 1)]
    assert len(out[0]["b"]) == 1 and out[1]["b"] == []


def test_links(spark):
    links = lambda *x: spark.createDataFrame([("c", a, b) for a, b in x], "case string, source int, target int")
    row = R.link_scores(links((1, 1), (2, 3)), links((1, 1), (2, 2)), links((1, 1), (2, 3)), "case").first()
    assert (row["predicted"], row["sure"], row["correct_sure"], row["correct_possible"]) == (2, 2, 1, 2)


def test_rank_correlation_counts_double_ties_twice(spark):
    df = spark.createDataFrame([("g", i, x, y) for i, (x, y) in enumerate([(1, 1), (2, 2), (3, 3), (3, 3)])], "k string, ord int, x int, y int")
    row = R.rank_correlation(df, ["k"], "x", "y").first()
    assert (row["concordant"], row["discordant"], row["tied_x"], row["tied_y"]) == (5, 0, 1, 1)
    assert row["tau"] == pytest.approx(5 / 6)


def test_spaced_sample_keeps_its_distance(spark):
    df = spark.createDataFrame([("v", i, float(i), i + 0.5) for i in range(50)], "k string, id int, start double, end double")
    a = SA.spaced(df, "k", "id", "s", 3.0, 8).orderBy("start").collect()
    assert len(a) <= 8 and all(y["start"] - x["end"] >= 3.0 for x, y in zip(a, a[1:]))
    assert [r["id"] for r in a] == [r["id"] for r in SA.spaced(df, "k", "id", "s", 3.0, 8).orderBy("start").collect()]


def test_chrf_of_equal_texts(spark):
    df = spark.createDataFrame([("das ist gut", "das ist gut"), ("abc", "xyz")], "r string, h string")
    assert [round(x[0], 3) for x in df.select(R.chrf("r", "h")).collect()] == [100.0, 0.0]


def test_first_and_all_failing(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    rules = [("small", F.col("x") < 3), ("odd", F.col("x") % 2 == 1)]
    out = df.select(SA.first_failing(rules).alias("f"), SA.all_failing(rules).alias("a")).collect()
    assert [(r["f"], r["a"]) for r in out] == [("small", ["small", "odd"]), ("odd", ["odd"]), ("odd", ["odd"])]


def test_language_probabilities(spark):
    top = [("es: Spanish", 0.3), ("es_MX", 0.1), ("ca", 0.25), ("zh-Hans", 0.2), ("yue", 0.05), ("pt-BR", 0.1)]
    df = spark.createDataFrame([(top, 0.4), ([], 0.0), (top, None)], "d array<struct<code: string, p: double>>, p double")
    rows = df.select(
        M.probability_of(F.col("d"), F.lit("es")).alias("own"), M.probability_of(F.col("d"), F.lit("zh")).alias("zh"),
        M.closed_set_probability(F.col("d"), F.lit("es"), ["es", "zh-CN", "pt"]).alias("closed"), M.pairwise_probability(F.col("d"), F.col("p"), F.lit("es")).alias("pair"),
    ).collect()
    assert rows[0]["own"] == pytest.approx(0.4) and rows[0]["zh"] == pytest.approx(0.25)
    assert rows[0]["closed"] == pytest.approx(0.4 / 0.75) and rows[0]["pair"] == pytest.approx(0.4 / 0.65)
    assert (rows[1]["closed"], rows[1]["pair"], rows[2]["pair"]) == (None, None, None)


def test_clip_limits(spark):
    df = spark.createDataFrame([(5.0, 6.0, 0.0), (5.0, 6.0, None), (5.0, 6.0, 6.2), (5.0, 6.0, 4.0), (0.1, 0.2, 0.05)], "s double, e double, d double")
    ends = [r[0] for r in df.select(M.clip_end(F.col("s"), F.col("e"), F.col("d"))).collect()]
    assert ends == pytest.approx([6.65, 6.65, 6.2, 4.75, 0.1])
