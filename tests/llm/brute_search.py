"""Plain versions of hard negatives, near vectors and collocations."""

import math
import re
from collections import Counter, defaultdict

import numpy as np


def finite(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def inner(x, y):
    return sum(a * b for a, b in zip(x, y))


def hard_negatives(rows):
    """``rows``: vec_id, label, embedding."""
    known = set()
    for ident, label, vector in rows:
        if ident is not None and label is not None and finite(vector):
            known.add((ident, (label + 1) % 10 if ident % 7 == 0 else label, tuple(math.floor(256 * float(x)) for x in vector)))
    known, out = sorted(known), []
    for a in known:
        if a[0] % 50:
            continue
        scores = {r: inner(a[2], r[2]) for r in known}
        order = sorted(known, key=lambda r: (-scores[r], r[0]))
        for p in [r for r in order if r != a and r[1] == a[1]][:5]:
            fit = [r for r in order if r[1] != a[1] and 50 * scores[p] <= 100 * scores[r] <= 95 * scores[p]]
            out += [(a[0], p[0], k + 1, r[0], scores[p], scores[r]) for k, r in enumerate(fit[:3])]
    return sorted(out)


def near_vectors(rows, cosine=0.9):
    """vec_id, links and component of each of ``rows`` (vec_id, embedding), by all pairs."""
    sound = [finite(v) and any(v) for _, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    unit = [np.array(v, float) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, sound)]
    unit = [v / np.sqrt(v @ v) if v is not None else None for v in unit]
    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for k, (ident, _) in enumerate(rows):
        groups[root(k)].append(ident)
    return [(ident, links[k], min((i for i in groups[root(k)] if i is not None), default=None)) for k, (ident, _) in enumerate(rows)]


def collocations(rows, least=10, top=2000, cover=50):
    """``rows``: text, lang."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= cover * candidates[q]}
        ranked = []
        for p in candidates.keys() - gone:
            score, _, left, right = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)
