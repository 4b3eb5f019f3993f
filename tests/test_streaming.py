from pyspark.sql import functions as F

from lexispan.streaming import captions as ST

SCHEMA = "track string, key string, at timestamp"


def source(spark, tmp_path, *batches):
    for k, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, "track string, key string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_utterances_close_after_a_pause(spark, tmp_path):
    stream = source(spark, tmp_path, [("a", "x", 10), ("a", "y", 11), ("a", "z", 30), ("a", "end", 500)])
    query = ST.utterances(stream, ["track"], "at", "5 seconds", "1 second").writeStream.format("memory").queryName("utt").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    found = spark.table("utt").orderBy("start").collect()
    assert [r["n_units"] for r in found] == [2, 1]


def test_batches_are_added_once(spark, tmp_path):
    stream = source(spark, tmp_path, [("a", "x", 10), ("a", "y", 11)])
    for _ in range(2):
        ST.appended(stream, lambda b: {"units": b}, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "units")).count() == 2
