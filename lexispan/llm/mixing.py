"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives every document a posterior over domains
(good, poor, toxic). Document rates r from 0 to ``most`` then minimise

    1/2 sum_k (sum_d r_d t_d p_dk - T_k)^2 / (T c_k)  +  ridge/2 sum_d t_d (r_d - 1)^2

where t are the document's tokens, T all tokens, T_k the target of domain k and c_k its
share before: the expected tokens of each domain meet their targets, with rates as near one
as that allows. The ridge is small enough that it moves no domain by a thousandth of its target, and keeps the answer
bounded where a target can't be met. Each step takes the gradient of all rates at once (K sums), scales it by the
Gram matrix of the posteriors of the documents that no bound holds (K * K sums in the same aggregate), and projects the rates to their bounds:
at the minimum a rate is 1 - sum_k p_k l_k so projected, so what a step carries to the next are the K numbers l. Steps end when the gradient is small,
after some ten passes over the posteriors. A rate becomes whole copies by a seeded draw of the document's id.

The classifier, a logistic regression of the domains, takes all words of a document, hashed to ``BUCKETS``, and bins of
its surface (symbols, capitals, digits, word length, repetition, length) for its features. No word is left out by a count
or a rank: an L1 penalty shrinks the weights, most of them to nothing, for most words tell languages apart, not domains.
It is fitted on at most about ``sample`` labelled documents, chosen by a hash, of which equal
ones count once; all else covers all rows.

Only DataFrame functions run on the rows. A null or blank text has no tokens, prior
posteriors and the rate that these give. Labels that are null count as 0; labels of no
document are ignored; a document labelled twice takes the worst of its labels. Without any
label the posterior is the target itself, so all rates are one. Rows that repeat an id get
the same rate if their texts are equal. An empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import documents, sized, stored, text_of

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
#: Labelled documents at most that the classifier is fitted on.
SAMPLE = 4_000
#: Buckets of words; bins of the surface have their own after these.
BUCKETS = 1 << 15
BINS = 32
#: Penalty of a weight's size, and steps of the fit.
SHRINK = 1e-3
FIT_STEPS = 150
#: The gradient, as a part of each target, at which the steps end; and passes at most, halved steps included.
PRECISION = 1e-4
STEPS = 60
RIDGE = 1e-6
SEED = 42


def _tokens(text: Column) -> Column:
    """Lower-cased words without the punctuation that ends them."""
    plain = F.regexp_replace(F.lower(text), r"[.,;:!?]+(?=\s|$)", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def _features(text: Column, words: Column, n: Column) -> Column:
    """The distinct words' buckets and the bins of the surface. ``words``: the distinct ones; ``n``: how many there are with repeats."""
    some, chars = F.greatest(n, F.lit(1)), F.greatest(F.length(text), F.lit(1))
    measures = [
        20 * F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / some,
        20 * F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        20 * F.regexp_count(text, F.lit(r"[0-9]")) / chars,
        20 * F.regexp_count(text, F.lit("!")) / some,
        chars / some,
        20 * F.size(words) / some,
        F.log2(some) * 2,
    ]
    bins = [BUCKETS + BINS * k + F.floor(F.least(m, F.lit(BINS - 1))) for k, m in enumerate(measures)]
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))
    return F.array_distinct(F.concat(hashed, F.array(*[b.cast("long") for b in bins])))


WIDTH = BUCKETS + BINS * 7


def featured(rows: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep``, tokens and features of every row."""
    cut = rows.select(*keep, text.alias("mix_text"), _tokens(text).alias("mix_words"))
    cut = cut.select(*keep, "mix_text", F.size("mix_words").cast("long").alias("tokens"), F.array_distinct("mix_words").alias("mix_words"))
    return cut.select(*keep, "tokens", _features(F.col("mix_text"), F.col("mix_words"), F.col("tokens")).alias("features"))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """domain and features of at most about ``sample`` labelled documents, chosen by a hash of their id."""
    flag = lambda c: F.max(F.coalesce(F.col(c).cast("int"), F.lit(0)))
    good = F.min(F.coalesce(F.col("quality").cast("int"), F.lit(0)))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(good.alias("quality"), flag("toxic").alias("toxic"))
    marked = stored(
        marked.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.when(F.col("toxic") > 0, 2).when(F.col("quality") < 1, 1).otherwise(0).alias("domain"),
        ),
        "mixing-labels",
    )
    parts = 1 << 20
    share = min(parts, sample * parts // max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(parts)) < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(sized(chosen, 32 * sample), "doc_id")
    return featured(rows, F.col("text"), ["domain"]).select("domain", F.sort_array("features").alias("features")).distinct()


@dataclass(frozen=True)
class Model:
    """base: of each domain; features: those with a weight; weights: of these, by domain."""

    base: list[float]
    features: list[int]
    weights: list[list[float]]

    def met(self, features: Column) -> Column:
        """Places in the model of the features that it knows."""
        place = [0] * WIDTH
        for k, f in enumerate(self.features):
            place[f] = k + 1
        table = F.from_json(F.lit(json.dumps(place)), "array<int>")  # folded to one constant
        return F.filter(F.transform(features, lambda b: F.get(table, b.cast("int"))), lambda k: k > 0)

    def scores(self, met: Column) -> list[Column]:
        """Log scores of the domains."""
        summed = lambda base, t: F.aggregate(met, F.lit(base), lambda a, k: a + F.get(t, k - 1))
        return [summed(base, F.from_json(F.lit(json.dumps(w)), "array<double>")) for base, w in zip(self.base, self.weights, strict=True)]


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def regression(domains: list[int], features: list[list[int]], shrink: float = SHRINK, steps: int = FIT_STEPS) -> Model:
    """Proximal gradient steps, scaled by each weight's past gradients."""
    ks, n = range(len(DOMAINS)), len(domains)
    row, f = np.repeat(np.arange(n), [len(x) for x in features]), np.concatenate([np.array(x, np.int64) for x in features])
    want = np.eye(len(DOMAINS))[np.array(domains)]
    w, seen = np.zeros((len(DOMAINS), WIDTH)), np.zeros((len(DOMAINS), WIDTH))
    base = np.log(want.mean(0) + 1 / (n + len(DOMAINS)))
    for _ in range(steps):
        error = _softmax(np.stack([np.bincount(row, w[k][f], n) for k in ks], 1) + base) - want
        for k in ks:
            pull = np.bincount(f, error[row, k], WIDTH) / n
            seen[k] += pull * pull
            size = 0.6 / (np.sqrt(seen[k]) + 1e-6)
            moved = w[k] - size * pull
            w[k] = np.sign(moved) * np.maximum(0.0, np.abs(moved) - size * shrink)
        base -= 0.5 * error.mean(0)
    known = np.flatnonzero(np.abs(w).max(0) > 0)
    return Model(base.tolist(), known.tolist(), [[round(float(x), 6) for x in w[k][known]] for k in ks])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    seen = sorted((r["domain"], r["features"]) for r in stored(labelled_sample(docs, labels, sample), "mixing-sample").collect())
    return regression([d for d, _ in seen], [f for _, f in seen]) if seen else None


def posteriors(docs: DataFrame, model: Model | None, keep: list[Column]) -> DataFrame:
    """``keep``, tokens, and p_<domain> of every document."""
    rows = docs.select(*keep, text_of(docs).alias("mix_text"))
    names = [c for c in rows.columns if c != "mix_text"]
    if model is None:
        tokens = F.size(_tokens(F.col("mix_text"))).cast("long").alias("tokens")
        return rows.select(*names, tokens, *[F.lit(TARGETS[d]).alias(f"p_{d}") for d in DOMAINS])
    ready = featured(rows, F.col("mix_text"), names).select(*names, "tokens", model.met(F.col("features")).alias("met"))
    scored = ready.select(*names, "tokens", *[s.alias(f"s{k}") for k, s in enumerate(model.scores(F.col("met")))])
    top = F.greatest(*[f"s{k}" for k in range(len(DOMAINS))])
    powers = scored.select(*names, "tokens", *[F.exp(F.col(f"s{k}") - top).alias(f"e{k}") for k in range(len(DOMAINS))])
    whole = sum((F.col(f"e{k}") for k in range(1, len(DOMAINS))), F.col("e0"))
    return powers.select(*names, "tokens", *[(F.col(f"e{k}") / whole).alias(f"p_{d}") for k, d in enumerate(DOMAINS)])


def _least(spare: tuple[str, ...]) -> Column:
    """Least rate: one for documents that are more likely than not of spared domains."""
    return F.when(sum((F.col(f"p_{d}") for d in spare), F.lit(0.0)) > 0.5, 1.0).otherwise(0.0) if spare else F.lit(0.0)


def _projected(pull: list[float], most: float | None, spare: tuple[str, ...]) -> Column:
    rate = F.greatest(sum((F.col(f"p_{d}") * F.lit(-float(pull[k])) for k, d in enumerate(DOMAINS)), F.lit(1.0)), _least(spare))
    return rate if most is None else F.least(rate, F.lit(float(most)))


def goals(share: list[float], targets: dict[str, float], spare: tuple[str, ...]) -> list[float]:
    """Target shares of all tokens; of the spared domains at least what they have, for which the others make room in proportion."""
    goal = [targets[d] / sum(targets.values()) for d in DOMAINS]
    kept = {k: max(goal[k], share[k]) for k, d in enumerate(DOMAINS) if d in spare}
    rest = sum(g for k, g in enumerate(goal) if k not in kept)
    return [kept[k] if k in kept else g * max(0.0, 1 - sum(kept.values())) / rest if rest else 0.0 for k, g in enumerate(goal)]


def fit_rates(
    members: DataFrame, targets: dict[str, float], steps: int = STEPS, ridge: float = RIDGE, most: float | None = None, spare: tuple[str, ...] = ()
) -> DataFrame:
    """``members`` (tokens, p_<domain>) with a rate. The table should be stored: it is read once a step. ``most``: largest
    rate, if any. ``spare``: domains of which nothing is given up: their target is raised to their present share, and a document that is
    more likely than not of them has a rate of one at least."""
    ks = range(len(DOMAINS))
    p, tokens = [F.col(f"p_{d}") for d in DOMAINS], F.col("tokens")
    before = members.agg(F.sum("tokens").alias("all"), *[F.sum(tokens * p[k]).alias(f"m{k}") for k in ks]).first()
    total = float(before["all"] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    share = np.array([max(before[f"m{k}"] / total, 1e-6) for k in ks])
    goal = np.array(goals(share.tolist(), targets, spare))
    pull, last, error = np.zeros(len(DOMAINS)), None, np.inf
    for _ in range(steps):
        rate = _projected(pull.tolist(), most, spare)
        free = (F.col("rate") > _least(spare)) & (F.lit(True) if most is None else F.col("rate") < most)
        now = members.select("tokens", *p, rate.alias("rate")).agg(
            *[F.sum(F.col("rate") * tokens * p[k]).alias(f"m{k}") for k in ks],
            *[F.sum(F.when(free, tokens * p[j] * p[k]).otherwise(0.0)).alias(f"g{j}{k}") for j in ks for k in ks if j <= k],
        ).first()
        gap = np.array([now[f"m{k}"] / total for k in ks]) - goal - ridge * share * pull
        if (np.abs(gap) <= PRECISION * np.maximum(goal, 1e-3)).all():
            break
        if last is not None and np.linalg.norm(gap / share) > error:
            pull = (pull + last) / 2
            continue
        gram = np.array([[now[f"g{min(j, k)}{max(j, k)}"] / total for k in ks] for j in ks])
        last, error = pull, np.linalg.norm(gap / share)
        pull = pull + np.linalg.solve(gram + ridge * np.diag(share), gap)
    return members.withColumn("rate", _projected(pull.tolist(), most, spare))


def _copies(seed: int) -> Column:
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tokens"), F.lit(1 << 30)) / (1 << 30)
    return (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE, most: float | None = None, spare: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, tokens, p_good, p_poor, p_toxic, rate, copies of every row of ``docs``."""
    model = fitted(docs, labels, sample)
    members = posteriors(docs, model, [F.col("doc_id").cast("long").alias("doc_id")])
    rated = fit_rates(stored(members, "mixing-members"), targets or TARGETS, most=most, spare=spare)
    return rated.withColumn("copies", _copies(SEED))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = SAMPLE, most: float | None = None, spare: tuple[str, ...] = (), ridge: float = RIDGE) -> DataFrame:
    """``docs`` with every row repeated or left out as its rate says."""
    model = fitted(docs, labels, sample)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = stored(posteriors(own, model, [F.col("row"), F.col("doc_id")]), "mixing-members")
    rated = fit_rates(members, targets or TARGETS, ridge=ridge, most=most, spare=spare).withColumn("copies", _copies(SEED)).where("copies > 0")
    repeated = rated.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def achieved(rated: DataFrame) -> DataFrame:
    """Each domain's share of the expected tokens, before and with the rates or the copies. ``rated``: of ``mixing_rates``."""
    parts = [F.struct(F.lit(d).alias("domain"), (F.col("tokens") * F.col(f"p_{d}")).alias("mass")) for d in DOMAINS]
    flat = rated.select("tokens", "rate", "copies", F.explode(F.array(*parts)).alias("m")).select("tokens", "rate", "copies", "m.*")
    sums = flat.groupBy("domain").agg(
        F.sum("tokens").alias("all"), F.sum("mass").alias("before"), F.sum(F.col("mass") * F.col("rate")).alias("expected"),
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.sum(F.col("mass") * F.col("copies")).alias("copied"),
    )
    return sums.select("domain", (F.col("before") / F.col("all")).alias("before"), (F.col("expected") / F.col("all")).alias("expected"), (F.col("copied") / F.col("drawn")).alias("drawn"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
