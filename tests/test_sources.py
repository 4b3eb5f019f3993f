import json
import wave

import pytest
from pyspark.sql import functions as F

from lexispan.functions import text as X
from lexispan.operators import caches as C
from lexispan.sources import annotations, captions, index_store


def test_conllu_shared_spans(spark, tmp_path):
    row = lambda i, form, lemma: "\t".join([i, form, lemma, "X", "_", "A=b|C=d", "_", "_", "_", "_"])
    sentence = "\n".join(["# text = Voy al mar", row("1", "Voy", "ir"), row("2-3", "al", "_"), row("2", "a", "a"), row("3", "el", "el"), row("4", "mar", "mar")])
    (tmp_path / "x.conllu").write_text(f"{sentence}\n\n{sentence}\n\n")
    rows = annotations.conllu(spark, str(tmp_path / "x.conllu")).collect()
    assert len(rows) == 2
    assert [(w["start"], w["end"], w["shared_span"]) for w in rows[0]["words"]] == [(0, 3, False), (4, 6, True), (4, 6, True), (7, 10, False)]


def test_pharaoh_links(spark, tmp_path):
    for name, text in (("s", "a b\nc\n"), ("t", "x y\nz\n"), ("a", "0-0 1?1\n0-0\n")):
        (tmp_path / name).write_text(text)
    rows = annotations.pharaoh(spark, *[str(tmp_path / n) for n in "sta"]).orderBy("line").collect()
    assert [(l["source"], l["target"], l["sure"]) for l in rows[0]["links"]] == [(0, 0, True), (1, 1, False)]
    assert rows[1]["source"] == ["c"]


def test_bad_annotations_are_errors(spark, tmp_path):
    row = lambda i, form: "\t".join([i, form, "x", "X", "_", "_", "_", "_", "_", "_"])
    for block, message in ((f"# text = a b\n{row('1', 'a')}\n2\tb", "columns"), (row("1", "a"), "# text"), (f"# text = a b\n{row('1', 'b')}\n{row('2', 'a')}", "isn't in its text")):
        with pytest.raises(ValueError, match=message):
            annotations.conllu_words(block)
    (tmp_path / "bad.conllu").write_text(f"# text = a\n{row('1', 'z')}\n\n")
    with pytest.raises(Exception, match="isn't in its text"):
        annotations.conllu(spark, str(tmp_path / "bad.conllu")).collect()
    for name, text in (("s", "a b\nc\n"), ("t", "x\nz\n"), ("short", "0-0\n"), ("odd", "0-0\n0+0\n")):
        (tmp_path / name).write_text(text)
    for links, message in (("short", "unequal"), ("odd", "not a link")):
        with pytest.raises(Exception, match=message):
            annotations.pharaoh(spark, *(str(tmp_path / n) for n in ("s", "t", links))).collect()


def test_lines_of_a_file_in_pieces(spark, tmp_path):
    (tmp_path / "long").write_text("".join(f"line {k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = annotations.numbered_lines(spark, str(tmp_path / "long"), "x")
        assert rows.where("x = concat('line ', line)").count() == 5000
        assert spark.read.text(str(tmp_path / "long")).select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vtt(spark):
    text = "WEBVTT\n\n00:01.500 --> 00:02.000\nHello <b>you</b>\nthere\n\n01:00:00.000 --> 01:00:01.000 align:start\nBye\n"
    cues = spark.createDataFrame([(text,)], "t string").select(annotations.vtt_cues(F.col("t")).alias("c")).first()["c"]
    assert [(c["start"], c["end"], c["text"]) for c in cues] == [(1.5, 2.0, "Hello you there"), (3600.0, 3601.0, "Bye")]


def test_waves(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", ""))
        w.writeframes(b"\0\0" * 8000)
    row = annotations.waves(spark, str(tmp_path)).first()
    assert (row["rate"], row["channels"], row["width"], row["seconds"]) == (16000, 1, 2, 0.5)


def test_catalogue(spark, tmp_path):
    listed = [{"id": "a-b", "name": "A", "url": "u", "enabled": False}, {"id": "a-b", "name": "B", "url": "u"}, {"id": "Bad_Id", "name": "C", "url": "u"}]
    (tmp_path / "es.json").write_text(json.dumps({"schema_version": 1, "language": "es", "sections": [{"id": "s", "name": "S", "channels": listed}]}))
    rows = captions.channels(spark, str(tmp_path))
    assert rows.where("enabled").count() == 2
    assert {(r["id"], r["problem"]) for r in captions.catalogue_problems(rows).collect()} == {("a-b", "listed twice"), ("Bad_Id", "not in kebab case")}


def test_stages(spark, tmp_path):
    index_store.write_stage(spark.range(2), str(tmp_path), "sample")
    assert index_store.latest_stage(spark, str(tmp_path), ["sample", "score"]).count() == 2
    index_store.write_stage(spark.range(5), str(tmp_path), "score")
    assert index_store.latest_stage(spark, str(tmp_path), ["sample", "score"]).count() == 5


def test_text_functions(spark):
    texts = ["🙂 ¡Sí, l’amigo!", "Straße_x 1'2", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(X.normalized_tokens(F.col("t")).alias("n"), X.tokens_with_spans("t").alias("s"), X.fold_udf("t").alias("f")).collect()
    assert [r["n"] for r in rows] == [["si", "l'amigo"], ["strasse", "x", "1'2"], [], None]
    assert [(s["surface"], s["start"], s["end"]) for s in rows[0]["s"]] == [("Sí", 3, 5), ("l’amigo", 7, 14)]
    assert rows[1]["f"] == "strasse_x 1'2"
    joined = spark.createDataFrame([("a", "."), ("¿", "b"), ("a", "b"), ("", "b")], "l string, r string").select(X.join_text(F.col("l"), F.col("r"))).collect()
    assert [j[0] for j in joined] == ["a.", "¿b", "a b", "b"]
    spans = df.where("t is not null").select(X.token_spans(F.col("t"), X.tokens(F.col("t"))).alias("s")).collect()
    assert [(s["start"], s["end"]) for s in spans[0]["s"]] == [(3, 5), (7, 14)]


def test_language_tags():
    assert X.canonical_language("ZH-hans-cn") == "zh-Hans-CN"
    assert X.canonical_language("ES") == "es"


def test_caches(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, created int")
    new = spark.createDataFrame([(2, "B", 30), (3, "c", 30)], "k int, v string, created int")
    assert {tuple(r) for r in C.merged(old, new, ["k"], ["created"]).collect()} == {(1, "a", 10), (2, "B", 20), (3, "c", 30)}
    assert {tuple(r) for r in C.replaced(old, new, ["k"]).collect()} == {(1, "a", 10), (2, "B", 30), (3, "c", 30)}
    kept, gone = C.deleted(old, F.col("created") < 15)
    assert kept.count() == 1 and gone.first()["deleted"] == 1
