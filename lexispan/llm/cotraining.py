"""Quality classifier by co-training.

Two classifiers see different sides of a document: its text (words and surface ratios) and
its page metadata (source, language, length). Each round, each of them scores all unlabelled documents
in their partitions and hands the ``HANDED`` of each kind that it is surest of, of the whole table, to the other one,
which learns from these. At last both are calibrated on labelled documents that neither has learned
from, a third fit weighs the calibrated log odds, and all documents are scored.

The driver holds at most about ``LABELLED`` labelled documents, chosen by a hash of the id, and the pseudo-labels that
were handed over, each as hashed words and a few numbers. A partition keeps as many candidates as are handed over, so
the choice from the whole table needs no shuffle of texts. Scoring reads every text whole, in its partition.

A document counts as good if its quality label isn't 0 and its toxic label isn't 1. A null
or blank text has no words; a null source or language is a value of its own; a null length is
0. Repeated rows get equal scores, and copies are handed over once. Labels without a document are ignored, and without
labels of both kinds every score is the share of good labels (1 if there are none). An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import documents, sized, stored

LABELLED = 4_000
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round, of each kind, and the least confidence.
HANDED = 100
SURE = 0.9
VOCABULARY = 1_000
MIN_DOCUMENTS = 4
SEED = 42
KEEP_AT = 0.5

_BUCKETS = 1 << 22
_STATS = 7
_META = 64
_ENDS = b".,;:!?"


def text_features(text: str | None) -> tuple[np.ndarray, list[float]]:
    """Hashes of the distinct words, and ratios of a text's surface."""
    text = text or ""
    data = text.lower().encode()
    words = data.split()
    distinct = {w.rstrip(_ENDS) for w in words}
    hashes = np.fromiter((zlib.crc32(w) & (_BUCKETS - 1) for w in distinct), np.int32, len(distinct))
    n = max(1, len(words))
    symbols = sum(data.count(c) for c in b"#*$%&|<>")
    lines = [x for x in data.split(b"\n") if x.strip()]
    stats = [
        min(symbols / n, 3.0),
        _upper_share(text),
        len(distinct) / n,
        min(len(data) / n, 20.0) / 10,
        min(np.log1p(n) / 10, 2.0),
        1 - len(set(lines)) / max(1, len(lines)),
        data.count(b"!") / n,
    ]
    return hashes, stats


def _upper_share(text: str) -> float:
    lowered = text.lower()
    if len(lowered) != len(text):
        return sum(map(str.isupper, text)) / len(text)
    a, b = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    return float((a != b).mean()) if len(a) else 0.0


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * _META
    out[zlib.crc32(f"source={source}".encode()) % 40] = 1.0
    out[40 + zlib.crc32(f"lang={lang}".encode()) % 16] = 1.0
    size = max(0, n_chars or 0)
    out[56 + min(6, len(str(size)) - 1)] = 1.0
    out[63] = float(np.log1p(size)) / 10
    return out


@dataclass
class Logistic:
    """Logistic regression with a ridge, by gradient steps with momentum on standardised columns."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> Logistic:
        mean, spread = x.mean(0), x.std(0)
        spread[spread < 1e-6] = 1.0
        z = ((x - mean) / spread).astype(np.float32)
        w, b, v, vb = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0
        size = 4.0 / (1.0 + float((z * z).sum(1).mean()) / 8)
        for _ in range(steps):
            e = (1 / (1 + np.exp(-(z @ w + b))) - y).astype(np.float32)
            v = 0.9 * v - size * 0.1 * (z.T @ e / len(y) + ridge * w)
            vb = 0.9 * vb - 0.1 * float(e.mean())
            w, b = w + v, b + vb
        self.weights = (w / spread).astype(np.float64)
        self.shift = float(b - mean @ self.weights)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.shift


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    vocabulary: dict[int, int]
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    joint: Logistic
    constant: float | None = None
    taught: int = 0

    def text_row(self, hashes: np.ndarray, stats: list[float]) -> np.ndarray:
        row = np.zeros(len(self.vocabulary) + _STATS)
        for h in hashes.tolist():
            if (at := self.vocabulary.get(h)) is not None:
                row[at] = 1.0
        row[len(self.vocabulary) :] = stats
        return row

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities by text and by metadata, and their combination."""
        a = self.text_scale.score(self.text.score(text)[:, None])
        b = self.meta_scale.score(self.meta.score(meta)[:, None])
        return _logistic(a), _logistic(b), _logistic(self.joint.score(np.stack([a, b], 1)))


_FEATURES = "hashes array<int>, stats array<double>, meta array<double>"


def _features(rows: list[tuple]) -> list[pa.Array]:
    """Columns of (hashes, stats, meta)."""
    doubles = pa.list_(pa.float64())
    return [pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], doubles), pa.array([r[2] for r in rows], doubles)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*text_features(r["text"]), meta_features(r["source"], r["lang"], r["n_chars"])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["good"], *_features(rows)], names=["doc_id", "good", "hashes", "stats", "meta"])


def _of_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and good (1 or 0), a row for each labelled document."""
    bad = F.max(F.when((F.coalesce(F.col("quality"), F.lit(0)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1), 1).otherwise(0))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - bad).alias("good"))


def sampled(docs: DataFrame, known: DataFrame, n_known: int, most: int = LABELLED) -> list:
    """Features of at most about ``most`` labelled documents."""
    parts = 1 << 20
    share = min(parts, most * parts // max(1, n_known))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(parts)) < share
    chosen = known.where(drawn)
    rows = _of_documents(docs).where(drawn).join(sized(chosen, 32 * most), "doc_id")
    found = stored(rows.select("doc_id", "text", "source", "lang", "n_chars", "good").mapInArrow(_sampled, f"doc_id long, good int, {_FEATURES}"), "cotraining-sample")
    return sorted(found.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"] or 0))


def _vocabulary(rows: list, good: np.ndarray) -> dict[int, int]:
    counts: dict[int, list[int]] = {}
    for r, g in zip(rows, good, strict=True):
        for h in r["hashes"]:
            counts.setdefault(h, [0, 0])[int(g)] += 1
    n = [max(1, int((good == k).sum())) for k in (0, 1)]
    strength = {}
    for h, (bad, fine) in counts.items():
        if bad + fine >= MIN_DOCUMENTS:
            a, b = (bad + 0.5) / (n[0] + 1), (fine + 0.5) / (n[1] + 1)
            strength[h] = abs(np.log(a / b)) / np.sqrt(1 / (bad + 0.5) + 1 / (fine + 0.5))
    best = sorted(strength, key=lambda h: (-strength[h], h))[:VOCABULARY]
    return {h: k for k, h in enumerate(sorted(best))}


#: A pseudo-label: the view that gives it, kind, confidence, the document's key and its features.
_HANDED_SCHEMA = f"view string, kind int, sure double, key long, {_FEATURES}"
_VIEWS = ("text", "meta")


def _surest(batches: Iterator[pa.RecordBatch], model: Model, taken: frozenset[int], most: int) -> Iterator[pa.RecordBatch]:
    """The ``most`` documents of this partition, copies counted once, that each view is surest of, for each kind."""
    best: dict[tuple[str, int], dict[int, tuple]] = {(view, kind): {} for view in _VIEWS for kind in (0, 1)}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = batch.slice(at, 512).to_pylist()
            found = [(*text_features(r["text"]), meta_features(r["source"], r["lang"], r["n_chars"])) for r in rows]
            scores = {"text": model.text.score(np.array([model.text_row(h, s) for h, s, _ in found])), "meta": model.meta.score(np.array([m for *_, m in found]))}
            for view, own in scores.items():
                p = _logistic(own)
                for kind in (0, 1):
                    sure, kept = p if kind else 1 - p, best[view, kind]
                    for k in np.flatnonzero(sure >= SURE).tolist():
                        key = rows[k]["key"]
                        if key not in taken and key not in kept:
                            kept[key] = (float(sure[k]), key, found[k])
                    if len(kept) > 4 * most:
                        best[view, kind] = {x[1]: x for x in heapq.nsmallest(most, kept.values(), key=lambda x: (-x[0], x[1]))}
    for (view, kind), kept in best.items():
        rows = heapq.nsmallest(most, kept.values(), key=lambda x: (-x[0], x[1]))
        if rows:
            head = [pa.array([view] * len(rows)), pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*head, *_features([r[2] for r in rows])], names=["view", "kind", "sure", "key", "hashes", "stats", "meta"])


def handed_over(unlabelled: DataFrame, model: Model, taken: set[int], most: int = HANDED) -> list:
    """The pseudo-labels of a round, from all unlabelled documents. A document goes to the first view that names it."""
    known = frozenset(taken)
    every = stored(unlabelled.mapInArrow(lambda b: _surest(b, model, known, most), _HANDED_SCHEMA), "cotraining-surest")
    out, gone = [], set(taken)
    for view in _VIEWS:
        for kind in (0, 1):
            # more than are needed, for partitions may hold copies of one text and the other lists may name it
            top = every.where((F.col("view") == view) & (F.col("kind") == kind)).dropDuplicates(["key"]).orderBy(F.desc("sure"), "key").limit(4 * most)
            fresh = [r for r in top.collect() if r["key"] not in gone][:most]
            gone.update(r["key"] for r in fresh)
            out += fresh
    return out


def fit(rows: list, hand_over: Callable[[Model, set[int]], list], rounds: int = ROUNDS) -> Model:
    """The two views taught by each other, calibrated on every fifth labelled row. ``hand_over``: a round's pseudo-labels by
    the present views, without the documents given."""
    good = np.array([r["good"] for r in rows])
    model = Model({}, Logistic(), Logistic(), Logistic(), Logistic(), Logistic())
    if len(set(good.tolist())) < 2 or len(rows) < 20:
        model.constant = float(good.mean()) if len(good) else 1.0
        return model
    held = np.arange(len(rows)) % 5 == 0
    learn = [r for r, h in zip(rows, held, strict=True) if not h]
    model.vocabulary = _vocabulary(learn, good[~held])
    features = {"text": lambda r: model.text_row(np.array(r["hashes"], np.int32), r["stats"]), "meta": lambda r: np.array(r["meta"])}
    lessons = {view: ([row(r) for r in learn], list(good[~held])) for view, row in features.items()}
    taken: set[int] = set()
    for turn in range(rounds + 1):
        model.text, model.meta = (Logistic().fit(np.array(lessons[view][0]), np.array(lessons[view][1])) for view in _VIEWS)
        given = hand_over(model, taken) if turn < rounds else []
        for r in given:
            other = "meta" if r["view"] == "text" else "text"
            lessons[other][0].append(features[other](r))
            lessons[other][1].append(r["kind"])
            taken.add(r["key"])
        if not given:
            break
    model.taught = len(taken)
    mine = {view: np.array([row(r) for r, h in zip(rows, held, strict=True) if h]) for view, row in features.items()}
    h = np.flatnonzero(held)
    a, b = model.text.score(mine["text"])[:, None], model.meta.score(mine["meta"])[:, None]
    model.text_scale, model.meta_scale = Logistic().fit(a, good[h]), Logistic().fit(b, good[h])
    both = np.stack([model.text_scale.score(a), model.meta_scale.score(b)], 1)
    model.joint = Logistic().fit(both, good[h])
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = part.to_pylist()
            if model.constant is None:
                text = np.array([model.text_row(*text_features(r["text"])) for r in rows])
                meta = np.array([meta_features(r["source"], r["lang"], r["n_chars"]) for r in rows])
                views = model.views(text, meta)
            else:
                views = (np.full(len(rows), model.constant),) * 3
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], *[pa.array(np.round(v, 6)) for v in views], pa.array(views[2] >= KEEP_AT)],
                names=["doc_id", "p_text", "p_meta", "score", "kept"],
            )


def fitted(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, most: int = LABELLED) -> Model:
    """The model, from labelled documents and all others."""
    known = stored(known_labels(labels), "cotraining-labels")
    n_known = known.count()
    rows = _of_documents(docs)
    key = F.xxhash64("text", "source", "lang", "n_chars").alias("key")
    unlabelled = rows.select("*", key).join(sized(known.select("doc_id"), 16 * n_known), "doc_id", "left_anti")
    return fit(sampled(docs, known, n_known, most), lambda model, taken: handed_over(unlabelled, model, taken), rounds)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_text, p_meta, score, kept of every row of ``docs``."""
    model = fitted(docs, labels)
    schema = "doc_id long, p_text double, p_meta double, score double, kept boolean"
    return _of_documents(docs).mapInArrow(lambda b: _scored(b, model), schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
