"""Annotated text: CoNLL-U sentences, word links in i-j notation, WebVTT cues, PCM waves."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.schemas import WORDS, struct


def conllu_words(block: str) -> tuple[str, list[dict]]:
    """Text of a sentence and its words with offsets; the words of a multi-word token share the token's span. Rows that haven't ten
    columns, sentences without ``# text`` and forms that aren't in the text behind the one before are errors."""
    lines = [x for x in block.splitlines() if x.strip()]
    text = next((x.split("=", 1)[1].strip() for x in lines if x.startswith("# text =")), None)
    rows = [x.split("\t") for x in lines if not x.startswith("#")]
    wrong = next((r for r in rows if len(r) != 10), None)
    if wrong:
        raise ValueError(f"a CoNLL-U row has {len(wrong)} columns: {wrong[0]!r}")
    if text is None:
        raise ValueError("a CoNLL-U sentence has no # text")
    spans: dict[int, tuple[int, int, bool]] = {}
    at = 0
    for number, form in ((r[0], r[1]) for r in rows if "." not in r[0]):
        first, _, last = number.partition("-")
        if int(first) in spans:
            continue  # a word of a token that has been placed
        start = text.find(form, at)
        if start < 0:
            raise ValueError(f"the CoNLL-U form {form!r} isn't in its text after character {at}")
        at = start + len(form)
        spans.update({k: (start, at, bool(last)) for k in range(int(first), int(last or first) + 1)})
    words = [r for r in rows if "." not in r[0] and "-" not in r[0]]
    named = (dict(zip(("id", "form", "lemma", "upos", "features"), (*r[:4], r[5])), **dict(zip(("start", "end", "shared_span"), spans[int(r[0])]))) for r in words)
    return text, list(named)


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """text and words of every sentence; files are cut at blank lines, so a sentence is a row and no file is held whole."""

    @F.pandas_udf(struct(text=T.StringType(), words=WORDS))
    def parsed(block: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([conllu_words(b) for b in block], columns=["text", "words"])

    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return blocks.select(parsed("value").alias("s")).select("s.*")


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """line (from 0) and ``name`` of one text file, read in as many pieces as it is split into: an id holds the piece and the place in it, and
    the lines of the pieces before are added."""
    read = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias(name))
    placed = read.select(F.shiftright("id", 33).alias("piece"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), name)
    counts = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))  # a row for each piece of the file
    before = F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.select("piece", before.alias("before"))), "piece").select((F.col("before") + F.col("place")).cast("int").alias("line"), name)


def pharaoh(spark: SparkSession, source: str, target: str, links: str) -> DataFrame:
    """line, source and target tokens, and their links; ``i-j`` is a sure link, ``i?j`` a possible one. Files of unequal length and links that are
    neither are errors when the rows are read."""
    s, t, a = (numbered_lines(spark, p, n) for p, n in ((source, "s"), (target, "t"), (links, "a")))
    joined = s.join(t, "line", "full_outer").join(a, "line", "full_outer")
    uneven = F.raise_error(F.concat(F.lit("the files have unequal lengths at line "), F.col("line").cast("string"))).cast("string")
    whole = joined.withColumn("a", F.when(F.col("s").isNull() | F.col("t").isNull() | F.col("a").isNull(), uneven).otherwise(F.col("a")))
    marks = F.filter(F.split("a", " "), lambda x: x != "")
    wrong = lambda x: F.raise_error(F.concat(F.lit("not a link: "), x)).cast("int")
    number = lambda x, k: F.when(x.rlike(r"^\d+[-?]\d+$"), F.element_at(F.split(x, "[-?]"), k).try_cast("int")).otherwise(wrong(x))
    pairs = F.transform(marks, lambda x: F.struct(number(x, 1).alias("source"), number(x, 2).alias("target"), x.contains("-").alias("sure")))
    return whole.select("line", F.split("s", " ").alias("source"), F.split("t", " ").alias("target"), pairs.alias("links"))


def vtt_cues(text):
    """Cues of WebVTT files as an array of (start, end, text); a column from a column."""
    cue = r"(?m)^((?:\d+:)?\d+:\d+\.\d+)\s+-->\s+((?:\d+:)?\d+:\d+\.\d+)[^\n]*\n((?:[^\n]+\n?)*)"
    seconds = lambda t: F.aggregate(F.split(t, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(cue), 1).alias("a"), F.regexp_extract_all(text, F.lit(cue), 2).alias("b"), F.regexp_extract_all(text, F.lit(cue), 3).alias("c")
    )
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    return F.transform(parts, lambda p: F.struct(seconds(p["a"]).alias("start"), seconds(p["b"]).alias("end"), clean(p["c"]).alias("text")))


def waves(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channels, width, seconds and samples (16-bit mono only) of wave files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    own = w.getparams()
                    out.append((p, own.framerate, own.nchannels, own.sampwidth, own.nframes / own.framerate, w.readframes(own.nframes)))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "width", "seconds", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, rate int, channels int, width int, seconds double, samples binary")
