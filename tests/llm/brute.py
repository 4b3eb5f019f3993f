"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_tokens(sequences, length):
    """For each sequence, the set of token places that a window found elsewhere covers."""
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = set()
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append(gone)
    return out


def removed_bytes(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    rows = []
    for d in data:
        last, gone = -1, bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                for k in range(max(i, last), i + length):
                    gone[k] = 1
                last = i + length
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        rows.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def removed_words(texts, length=35):
    words = [WORD.findall(t or "") for t in texts]
    rows = []
    for w, gone in zip(words, removed_tokens(words, length)):
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        rows.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """Least index reachable for each of a list of fingerprints."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 20 or 100 * len(repeated) > 30 * len(words),
    )
