"""Mixing, the classifier, audio fingerprints, the pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.llm import chroma, cotraining, mixing
from lexispan.llm.common import settings

DOMAINS = mixing.DOMAINS


def solved(tokens, p, goal, most=np.inf, least=0.0, ridge=mixing.RIDGE):
    """The same minimum by plain projected gradient steps on all rates, very many of them."""
    total, share = tokens.sum(), (tokens[:, None] * p).sum(0) / tokens.sum()
    rate = np.ones(len(tokens))
    for _ in range(60_000):
        g = ((rate * tokens) @ p / total - goal) / share
        rate = np.clip(rate - (p @ g + ridge * (rate - 1)), least, most)
    return rate


@pytest.mark.parametrize("most", [None, 2.1])
def test_rates_meet_targets(spark, most):
    draw = np.random.default_rng(2)
    p = draw.dirichlet([0.3] * 3, 400)
    tokens = draw.integers(5, 400, 400)
    members = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p_good double, p_poor double, p_toxic double")
    goal = np.array([0.5, 0.47, 0.03])
    got = mixing.fit_rates(members, dict(zip(DOMAINS, goal.tolist())), most=most).orderBy("doc_id").toPandas().rate.to_numpy()
    assert (got == 0).sum() > 5 and (most is None or (got == most).sum() > 5)
    plain = solved(tokens, p, goal, most or np.inf)
    for rate in (got, plain):  # within one in a thousand of each target
        assert np.abs((rate * tokens) @ p / tokens.sum() / goal - 1).max() < 1e-3
    cost = lambda r: float(tokens @ (r - 1) ** 2)
    assert cost(got) <= cost(plain) * 1.001


def test_targets_out_of_reach_give_bounded_rates(spark):
    members = spark.createDataFrame([(i, 10, 0.5, 0.3, 0.2) for i in range(20)], "doc_id long, tokens long, p_good double, p_poor double, p_toxic double")
    rates = [r["rate"] for r in mixing.fit_rates(members, {"good": 0.9, "poor": 0.1, "toxic": 0.0}).collect()]
    assert len(set(rates)) == 1 and 0 <= rates[0] < 3


def test_given_tables_meet_their_targets(spark):
    rated = mixing.op4_mixing(spark, "/root/testdata/sf0.01")
    found = {r["domain"]: r["expected"] for r in mixing.achieved(rated).collect()}
    assert all(abs(found[d] / t - 1) < 0.01 for d, t in mixing.TARGETS.items())


def plain_features(text):
    """Buckets of the words and bins of the surface, for texts of ASCII."""
    import re

    import xxhash

    words = [w for w in re.split(r"\s+", re.sub(r"[.,;:!?]+(?=\s|$)", "", text.lower())) if w]
    some, chars, distinct = max(1, len(words)), max(1, len(text)), set(words)
    measures = [
        20 * len(re.findall(r"[#*$%&|<>]", text)) / some, 20 * len(re.findall("[A-Z]", text)) / chars, 20 * len(re.findall("[0-9]", text)) / chars,
        20 * text.count("!") / some, chars / some, 20 * len(distinct) / some, np.log2(some) * 2,
    ]
    signed = lambda w: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(w.encode(), 42))
    bins = {mixing.BUCKETS + mixing.BINS * k + int(min(m, mixing.BINS - 1)) for k, m in enumerate(measures)}
    return len(words), {signed(w) % mixing.BUCKETS for w in distinct} | bins


def plain_copies(doc_id, tokens, rate):
    import xxhash

    chain = 42
    for value, size in ((mixing.SEED, 4), (doc_id, 8), (tokens, 8)):
        chain = xxhash.xxh64_intdigest(value.to_bytes(size, "little"), chain)
    return int(rate) + ((chain % 2**30) / 2**30 < rate - int(rate))


def test_posteriors_and_copies_equal_plain_ones(spark):
    import random

    draw = random.Random(8)
    vocabulary = [f"word{k}" for k in range(200)] + ["Loud!", "##", "100%", "x,"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60))) for _ in range(120)] + ["", " \n"]
    rows = [plain_features(t) for t in texts]
    model = mixing.regression([k % 3 for k in range(60)], [sorted(f) for _, f in rows[:60]])
    assert len(model.features) > 20
    weight = {f: [w[k] for w in model.weights] for k, f in enumerate(model.features)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = mixing.posteriors(docs, model, [F.col("doc_id")]).withColumn("rate", F.col("p_good") * 3).withColumn("copies", mixing._copies(mixing.SEED))
    for r in found.collect():
        n, features = rows[r["doc_id"]]
        scores = np.array(model.base) + sum((np.array(weight[f]) for f in features if f in weight), np.zeros(3))
        want = np.exp(scores - scores.max())
        assert r["tokens"] == n
        assert np.abs(np.array([r[f"p_{d}"] for d in DOMAINS]) - want / want.sum()).max() < 1e-9
        assert r["copies"] == plain_copies(r["doc_id"], n, r["rate"])


def test_mixing_of_odd_rows(docs, labels, empty):
    rates = mixing.mixing_rates(docs, labels).collect()
    assert len(rates) == docs.count()
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rates)
    assert all(abs(r["p_good"] + r["p_poor"] + r["p_toxic"] - 1) < 1e-9 for r in rates)
    assert mixing.mixing_rates(empty, labels).collect() == []
    assert {round(r["rate"], 6) for r in mixing.mixing_rates(docs, labels.limit(0)).collect()} == {1.0}


def test_mixing_finds_words_of_a_domain(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("plain words here"), F.col("id"), F.when(F.col("id") % 5 == 0, "vile")).alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    out = mixing.mixing_rates(docs, labels, {"good": 0.99, "poor": 0.0, "toxic": 0.01}).where("doc_id >= 300")
    assert out.where("doc_id % 5 = 0 and p_toxic > 0.9 and rate < 0.3").count() == 60
    assert out.where("doc_id % 5 != 0 and p_good > 0.9 and rate >= 1").count() == 240


@pytest.fixture(scope="module")
def reviewed(spark):
    """Documents of two kinds, told apart by words and, less well, by source."""
    draw = np.random.default_rng(4)
    good = [f"g{k}" for k in range(30)]
    bad = [f"b{k}##" for k in range(30)]
    rows, labels = [], []
    for i in range(900):
        fine = bool(draw.random() < 0.7)
        words = draw.choice(good if fine else bad, 25).tolist() + draw.choice(good, 10).tolist()
        source = ("a" if fine else "b") if draw.random() < 0.8 else "c"
        rows.append((i, " ".join(words), "en", source, 100))
        labels.append((i, int(fine), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_holds_on_unseen_documents(reviewed):
    docs, labels = reviewed
    scores = cotraining.quality_scores(docs, labels.where("doc_id < 300")).join(labels, "doc_id").where("doc_id >= 300")
    right = scores.where("kept = (quality = 1)").count() / scores.count()
    assert right > 0.97


def test_views_teach_each_other(reviewed):
    docs, labels = reviewed
    few = labels.where("doc_id < 60")
    known = cotraining.known_labels(few)
    rows = cotraining.sampled(docs, known, known.count())
    assert sorted(r["doc_id"] for r in rows) == list(range(60))
    asked = []

    def plain(model, taken):
        """Of all unlabelled documents those that each view is surest of, worked out in one place."""
        every = [(r["doc_id"], *cotraining.text_features(r["text"]), cotraining.meta_features(r["source"], r["lang"], r["n_chars"])) for r in docs.where("doc_id >= 60").collect()]
        scores = {"text": model.text.score(np.array([model.text_row(h, s) for _, h, s, _ in every])), "meta": model.meta.score(np.array([m for *_, m in every]))}
        keys = {r["doc_id"]: r["key"] for r in docs.select("doc_id", F.xxhash64("text", "source", "lang", "n_chars").alias("key")).collect()}
        out, gone = set(), set(taken)
        for view in ("text", "meta"):
            p = 1 / (1 + np.exp(-np.clip(scores[view], -30, 30)))
            for kind in (0, 1):
                ranked = sorted((-(q if kind else 1 - q), keys[every[k][0]]) for k, q in enumerate(p) if (q if kind else 1 - q) >= cotraining.SURE)
                mine = [key for _, key in ranked if key not in gone][: cotraining.HANDED]
                gone.update(mine)
                out.update((view, kind, key) for key in mine)
        return out

    unlabelled = cotraining._of_documents(docs).where("doc_id >= 60").withColumn("key", F.xxhash64("text", "source", "lang", "n_chars"))

    def hand_over(model, taken):
        got = cotraining.handed_over(unlabelled, model, taken)
        assert {(r["view"], r["kind"], r["key"]) for r in got} == plain(model, taken)
        asked.append(len(got))
        return got

    model = cotraining.fit(rows, hand_over)
    assert model.constant is None and len(model.vocabulary) > 10
    assert asked[0] > 100 and model.taught == sum(asked)


def test_classifier_of_odd_rows(docs, labels, empty):
    assert cotraining.quality_scores(docs, labels).count() == docs.count()
    assert cotraining.quality_scores(empty, labels).collect() == []
    assert {r["score"] for r in cotraining.quality_scores(docs, labels.limit(0)).collect()} == {1.0}


def plain_fingerprint(media):
    """The codes from direct sums instead of an integral image."""
    samples = np.frombuffer(media, np.uint8)
    least = chroma.FRAME + (chroma.SPAN - 1) * chroma.HOP
    samples = np.concatenate((samples, np.full(max(0, least - len(samples)), 128, np.uint8)))
    frames = chroma.chroma(samples)
    out = []
    for t in range(len(frames) - chroma.SPAN + 1):
        box = lambda a, b, c, d: frames[t + a : t + b, c:d].sum()  # noqa: B023, E731
        code = 0
        for kind, width, low, height in chroma._FILTERS:
            mid, half, third = low + height // 2, width // 2, width // 4
            high = low + height
            a, b = {
                0: lambda: (box(0, half, low, high), box(half, width, low, high)),
                1: lambda: (box(0, width, low, mid), box(0, width, mid, high)),
                2: lambda: (box(0, half, low, mid) + box(half, width, mid, high), box(0, half, mid, high) + box(half, width, low, mid)),
                3: lambda: (box(third, width - third, low, high), box(0, third, low, high) + box(width - third, width, low, high)),
            }[kind]()
            level = sum(np.log((1e-3 + a) / (1e-3 + b)) >= c for c in chroma.CUTS)
            code = code << 2 | (level ^ level >> 1)
        out.append(code)
    return np.array(out, np.uint32)


def tone(seed, n=6000):
    draw = np.random.default_rng(seed)
    parts = [128 + 100 * np.sin(2 * np.pi * f * np.arange(500) / chroma.RATE) for f in draw.uniform(100, 3000, n // 500)]
    return np.concatenate(parts).astype(np.uint8).tobytes()


def test_fingerprints_equal_direct_sums():
    for seed in range(3):
        assert (chroma.fingerprint(tone(seed)) != plain_fingerprint(tone(seed))).mean() < 0.01
    assert len(chroma.fingerprint(b"")) == 0 and len(chroma.fingerprint(None)) == 0 and len(chroma.fingerprint(b"ab")) == 1


def test_recordings_align(spark):
    a, b = tone(1), tone(2)
    late = a[chroma.HOP * 20 :]
    rows = spark.createDataFrame([(1, a), (2, late), (3, b), (4, a), (5, None), (None, b), (6, b"")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in chroma.aligned(rows).collect()}
    assert (got[2]["ref_id"], got[2]["code_offset"], got[2]["class_id"]) == (1, -20, 1)
    assert got[2]["bit_error"] < 0.01 and got[4]["bit_error"] == 0 and got[4]["class_id"] == 1
    assert got[5]["n_codes"] == 0 and got[5]["class_id"] == 5 and got[6]["class_id"] == 6
    assert got[3]["class_id"] == 3 and got[3]["ref_id"] is None and got[None]["class_id"] == 3 and got[None]["ref_id"] == 3
    assert (got[1]["n_links"], got[3]["n_links"], got[2]["ref_id"]) == (1, 0, 1)
    assert chroma.aligned(rows.limit(0)).collect() == []


def heard(rows, spark):
    table = spark.createDataFrame(rows, "doc_id long, media binary")
    return {r["doc_id"]: r for r in chroma.aligned(table).collect()}


def test_recall_of_altered_recordings(spark):
    """Shifts that aren't multiples of the hop, noise, volume; and unlike recordings with one silent tail stay apart."""
    draw = np.random.default_rng(9)
    rows = []
    for k in range(12):
        own = np.frombuffer(tone(100 + k, 8000), np.uint8)
        rows.append((k, own.tobytes()))
        rows.append((100 + k, own[13:].tobytes()))
        rows.append((200 + k, np.clip(own + draw.normal(0, 4, len(own)), 0, 255).astype(np.uint8).tobytes()))
        rows.append((300 + k, (128 + (own.astype(int) - 128) // 2).astype(np.uint8).tobytes()))
    got = heard(rows, spark)
    right = sum(got[h + k]["class_id"] == k for k in range(12) for h in (100, 200, 300))
    assert right >= 33 and all(got[k]["class_id"] == k for k in range(12))
    tail = bytes([128]) * 6000
    quiet = heard([(1, tone(1, 3000) + tail), (2, tone(2, 3000) + tail)], spark)
    assert quiet[2]["ref_id"] is None or quiet[2]["bit_error"] <= chroma.MAX_ERROR


def test_alignment_beyond_the_first_holder(spark):
    """A recording that copies all of another is aligned with it, though an earlier one shares a little of both."""
    long, part = tone(31, 9000), tone(32, 1500)
    got = heard([(1, tone(33, 6000) + part), (2, long + part), (3, long + part + tone(34, 500))], spark)
    assert got[3]["ref_id"] == 2 and got[3]["code_offset"] == 0


def plain_links(rows):
    """Pairs (later, earlier) of unlike recordings from all pairs: landmarks in common at one offset, then bit errors."""
    codes = {i: chroma.fingerprint(m) for i, m in rows}
    marks = {i: chroma.landmarks(c) for i, c in codes.items()}
    held, met, links = defaultdict(list), defaultdict(Counter), {}
    for i in sorted(codes):
        for at, key in chroma.keys(marks[i]):
            for j, other in held[key]:
                if i != j:
                    met[i, j][at - other] += 1
            held[key].append((i, at))
    for (i, j), votes in met.items():
        offset = max(votes, key=lambda o: (votes[o], -abs(o), o))
        late, early = max(offset, 0), max(-offset, 0)
        n = min(len(codes[i]) - late, len(codes[j]) - early)
        wrong = np.bitwise_count(codes[i][late : late + n] ^ codes[j][early : early + n]).sum() / (32 * n)
        if votes[offset] >= min(chroma.VOTES, len(marks[i])) and wrong <= chroma.MAX_ERROR:
            links[i, j] = round(float(wrong), 6)
    return links


def plain_classes(rows):
    root = {i: i for i, _ in rows}
    first = {}
    copies = [(i, first.setdefault(m, i)) for i, m in sorted(rows)]
    for i, j in [*plain_links(rows), *copies]:
        low, high = sorted((root[i], root[j]))
        root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_links_equal_all_pairs_on_a_given_table(spark):
    """Every link of all pairs is found, and no other, with its share of differing bits."""
    table = "/root/testdata/sf0.01/documents.parquet"
    media = spark.read.parquet(table).select("doc_id", F.encode("text", "UTF-8").alias("media")).groupBy("media").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "media")
    prints = chroma.fingerprints(media).withColumn("node", F.struct("t1", "t2")).withColumnRenamed("doc_id", "least")
    ids = prints.select("node", "least")
    graded = chroma.alignments(prints).where(F.col("bit_error") <= chroma.MAX_ERROR)
    named = graded.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    want = plain_links([(r["doc_id"], bytes(r["media"])) for r in media.collect()])
    assert {(r["x"], r["y"]): r["bit_error"] for r in named.collect()} == want and want


def test_links_of_crowded_keys_equal_all_pairs(spark, monkeypatch):
    """More recordings than CROWD share all or a part: number of links, best link and class are those of all pairs, over several packs."""
    monkeypatch.setattr(chroma, "PACK", 32)
    draw = np.random.default_rng(12)
    whole, jingle = tone(41, 5000), tone(42, 2500)
    rows = [(k, whole[64 * (k % 7) :] + tone(300 + k, 700)) for k in range(80)]
    rows += [(100 + k, tone(500 + k, 2000 + 500 * (k % 3)) + jingle) for k in range(70)]
    rows += [(200 + k, tone(500 + k, 2000 + 500 * (k % 3)) + jingle + tone(700 + k, 500)) for k in range(0, 70, 9)]
    rows += [(300 + k, tone(900 + k // 2, 3000) + bytes(draw.integers(0, 255, 30 + k, np.uint8))) for k in range(6)]
    links = plain_links(rows)
    assert len(links) > 3000
    ends, got = Counter(i for pair in links for i in pair), heard(rows, spark)
    assert {i: r["n_links"] for i, r in got.items()} == {i: ends[i] for i, _ in rows}
    assert {i: r["class_id"] for i, r in got.items()} == plain_classes(rows)
    for i, r in got.items():
        earlier = {j: e for (x, j), e in links.items() if x == i}
        assert abs(r["bit_error"] - earlier[r["ref_id"]]) < 2e-6 if earlier else r["ref_id"] is None


@pytest.mark.parametrize("bits", [1 << 6, chroma.FILTER_BITS])
def test_holders_of_shared_keys_are_whole(spark, monkeypatch, bits):
    """All places of keys that several recordings hold and no others, also where the filter lets every key through."""
    monkeypatch.setattr(chroma, "FILTER_BITS", bits)
    part, hum = tone(51, 2000), tone(52, 500) * 8
    rows = [(k, tone(60 + k, 3000) + part * (k % 3)) for k in range(9)] + [(20, hum), (21, hum + tone(53, 900)), (22, tone(54, 500) * 8)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "doc_id long, media binary")).withColumnRenamed("doc_id", "least")
    held = defaultdict(list)
    for i, media in rows:
        for at, key in chroma.keys(chroma.landmarks(chroma.fingerprint(media))):
            held[key].append((i, at))
    want = sorted((i, at, key, len(places)) for key, places in held.items() if len({i for i, _ in places}) > 1 for i, at in places)
    assert want and sorted(tuple(r) for r in chroma.holders(prints).select("least", "at", "mark", "n").collect()) == want


def test_keys_of_one_holder_are_not_moved(spark):
    """Without broadcasts, what is shuffled is a small multiple of the codes and keys: joins don't move keys that nobody shares, nor the nodes."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        found = store.executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    rows = [(k, tone(3000 + k // 2 if k < 40 else 4000 + k, 6000) + bytes([k % 250] * 9)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, media binary")
    size = chroma.fingerprints(table).select(F.sum(4 * F.size("codes") + 12 * F.size("keys"))).first()[0]
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        before = written()
        got = {r["doc_id"]: r["n_links"] for r in chroma.aligned(table).collect()}
    ends = Counter(i for pair in plain_links(rows) for i in pair)
    assert got == {i: ends[i] for i, _ in rows} and len(ends) >= 40
    assert written() - before < 6 * size  # 4.1 times; 7.9 when joins moved all keys


def test_classes_equal_plain_pairs(spark, docs, empty, tmp_path):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null and doc_id != 3").collect()]
    rows = [(i, t.encode()) for i, t in texts if not t or len(set(t)) > 3]  # a steady tone fits itself at every offset
    rows += [(500 + k, tone(60 + k // 3)[: 6000 - 640 * (k % 3)]) for k in range(9)]
    got = {i: r["class_id"] for i, r in heard(rows, spark).items()}
    assert got == plain_classes(rows) and len(set(got.values())) < len(got)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert chroma.op7_chroma_alignment(spark, f"{tmp_path}/odd").count() == docs.count()
    assert chroma.op7_chroma_alignment(spark, f"{tmp_path}/none").collect() == []


def near_components(texts):
    """Least index reachable over pairs whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append(set(zip(*[words[k:] for k in range(5)])) or {tuple(words)})
    root = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return root


def test_mixing_holds_to_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    rates = mixing.op4_mixing(spark, sf)
    shares = {r["domain"]: r for r in mixing.achieved(rates).collect()}
    assert all(abs(shares[d]["expected"] - t) < 0.02 for d, t in mixing.TARGETS.items())


def test_clean_corpus_is_not_thinned_out(spark):
    rows = [(i, 10, float(i < 95), float(i >= 95), 0.0) for i in range(100)]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p_good double, p_poor double, p_toxic double")
    goal = {"good": 0.8, "poor": 0.2, "toxic": 0.0}
    assert mixing.fit_rates(members, goal).where("p_good = 1 and rate < 0.9").count() == 95
    assert mixing.fit_rates(members, goal, spare=("good",)).where("p_good = 1 and rate < 0.999").count() == 0


def test_pipeline_equals_plain_versions(spark):
    """Every stage on all that the one before kept, against a plain version of it."""
    import base64
    import hashlib

    import brute
    import corpus_pipeline
    import duckdb
    import public_tokenizers as P
    import tiktoken
    from lexispan.llm import byte_pairs, oracle
    from lexispan.llm.common import stored

    sf = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    texts = {r["doc_id"]: r["text"] for r in start.collect()}

    out = []
    docs = start
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        out.append(docs)
    rules, near, rest, mixed, coded = out

    kept = [r[0] for r in con.execute(f"select doc_id from ({oracle.QUALITY_RULES}) where kept order by doc_id").fetchall()]
    assert sorted(r["doc_id"] for r in rules.collect()) == kept and 0 < len(kept) < len(texts)

    root = near_components([texts[i] for i in kept])
    first = sorted({kept[r] for r in root})
    assert sorted(r["doc_id"] for r in near.collect()) == first and len(first) < len(kept)

    removed = brute.removed_tokens([texts[i].split() for i in first], 35)
    plain = {i: " ".join(w for k, w in enumerate(texts[i].split()) if k not in gone) if gone else texts[i] for i, gone in zip(first, removed)}
    assert {r["doc_id"]: r["text"] for r in rest.collect()} == plain

    known = mixing.posteriors(rest, mixing.fitted(rest, labels), [F.col("doc_id")]).toPandas()
    tokens, p = known.tokens.to_numpy(), known[[f"p_{d}" for d in DOMAINS]].to_numpy()
    goal = mixing.goals(((tokens @ p) / tokens.sum()).tolist(), corpus_pipeline.TARGETS, corpus_pipeline.SPARED)
    spared = np.where(p[:, [DOMAINS.index(d) for d in corpus_pipeline.SPARED]].sum(1) > 0.5, 1.0, 0.0)
    rate = solved(tokens, p, np.array(goal), corpus_pipeline.MOST, spared, corpus_pipeline.EVEN)
    copies = Counter({i: plain_copies(i, int(n), r) for i, n, r in zip(known.doc_id.tolist(), tokens, rate)})
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert sum(abs(got[i] - copies[i]) for i in plain) <= 1  # a draw may fall between two rates that differ by rounding
    assert all(got[i] for i, s in zip(known.doc_id.tolist(), spared) if s)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_pairs.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n_tokens = {i: len(library.encode_ordinary(t)) for i, t in plain.items()}
    want = Counter((r["doc_id"], n_tokens[r["doc_id"]], hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in coded.collect()) == want


def test_pipeline_stages_on_odd_rows(spark, docs, labels, empty, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()
