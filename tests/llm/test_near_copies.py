"""Near copies among pages of a template: candidates stay few, and none at the threshold is lost."""

import random

import numpy as np

from lexispan.llm import near_copies


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def candidates(spark, monkeypatch, texts):
    """Pairs that are verified, and components by text."""
    seen, plain = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets, label: (seen.append(pairs.count()), plain(pairs, sets, label))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component"] for r in near_copies.near_components(docs).collect()}
    monkeypatch.setattr(near_copies, "_verified", plain)
    return sum(seen), found


def test_pages_of_a_template(spark, monkeypatch):
    """140 words of all pages and 45 of its own: similar by about 0.6, and no pair links."""
    draw = random.Random(4)
    template = [f"t{draw.randrange(10**6)}" for _ in range(140)]
    page = lambda: " ".join([*template[:70], *(f"o{draw.randrange(10**7)}" for _ in range(45)), *template[70:]])
    pages, verified = [page() for _ in range(800)], []
    for n in (400, 800):
        count, found = candidates(spark, monkeypatch, pages[:n])
        assert len(set(found.values())) == n
        verified.append(count)
    # a star for each band of a page at most, and hardly more: all pairs would be 80,000 and 320,000
    assert verified[1] < 30 * 800 and verified[1] < 2.5 * verified[0]


def test_near_copies_among_pages_of_a_template(spark, monkeypatch):
    """Every page has one partner at 0.8 or a little above, and resembles all others by about 0.7."""
    draw = random.Random(5)
    template = [f"t{draw.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        own = [f"o{draw.randrange(10**7)}" for _ in range(40)]
        texts.append(" ".join([*template[:100], *own, *template[100:]]))
        for k in draw.sample(range(36), 2):
            own[k] = f"n{draw.randrange(10**7)}"
        cut = draw.randrange(20, 26)
        texts.append(" ".join([*template[:100], *own, *template[100 : 200 - cut]]))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if similar(sets[i], sets[j])]
    assert len(pairs) > 100
    _, found = candidates(spark, monkeypatch, texts)
    lost = [p for p in pairs if found[p[0]] != found[p[1]]]
    assert lost == []


def test_differences_meet_whatever_is_common():
    """Similar sets of which one is far from the centre share a shingle from which on enough is left, and it is in the first half of one."""
    draw, met = np.random.default_rng(6), 0
    common = np.frombuffer(draw.bytes(near_copies.FILTER_BITS // 8), np.uint8)
    for _ in range(400):
        centre = np.unique(draw.integers(-(2**62), 2**62, int(draw.integers(20, 80))))

        def edited(of, most):
            out = of.copy()
            for _ in range(int(draw.integers(0, most + 1))):
                out[draw.integers(len(out))] = draw.integers(-(2**62), 2**62)
            return np.unique(out[: len(out) - int(draw.integers(0, 3))])

        x = edited(centre, len(centre) // 3)
        y = edited(x, len(x) // 10)
        if not similar(set(x.tolist()), set(y.tolist())) or all(similar(set(z.tolist()), set(centre.tolist())) for z in (x, y)):
            continue
        met += 1
        dx, dy = (near_copies.difference(z, centre, common).tolist() for z in (x, y))
        assert set(dx) == set(x.tolist()) ^ set(centre.tolist())
        need = (len(dx) + len(dy) - (len(x) + len(y)) / 9) / 2
        shared = [(i, dy.index(g)) for i, g in enumerate(dx) if g in dy]
        assert need > 0 and any(min(len(dx) - i, len(dy) - j) >= need for i, j in shared)
        half = lambda d, z: (len(d) + (len(z) - len(centre)) / 9) / 2
        far = lambda z: not similar(set(z.tolist()), set(centre.tolist()))
        fits = [(i, j) for i, j in shared if min(len(dx) - i, len(dy) - j) >= need]
        assert any((far(y) and i < half(dx, x)) or (far(x) and j < half(dy, y)) for i, j in fits)
    assert met > 40


def test_large_bands_lose_no_pair(spark, monkeypatch):
    """Every band counts as large: all is found by the differences from centres."""
    monkeypatch.setattr(near_copies, "SMALL", 0)
    monkeypatch.setattr(near_copies, "COMMON", 3)
    draw = random.Random(7)
    base = [[f"w{draw.randrange(400)}" for _ in range(draw.randint(6, 120))] for _ in range(40)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            for _ in range(draw.randint(1, max(1, len(words) // 25))):
                other[draw.randrange(len(other))] = f"new{draw.randrange(50)}"
            texts.append(" ".join(other))
    sets = [shingles(t) for t in texts]
    _, found = candidates(spark, monkeypatch, texts)
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if similar(sets[i], sets[j])]
    assert len(pairs) > 50 and all(found[i] == found[j] for i, j in pairs)


def test_copies_edited_too_much(spark, monkeypatch):
    """Edits of one page, a little less alike than 0.8: candidates stay few, and pairs with the same edits are found."""
    draw = random.Random(8)
    page, verified = [f"t{draw.randrange(10**6)}" for _ in range(150)], []

    def edit(words, n):
        out = list(words)
        for k in draw.sample(range(len(out)), n):
            out[k] = f"e{draw.randrange(10**6)}"
        return out

    texts = [edit(page, 4) for _ in range(500)]
    texts += [edit(t, 1) for t in texts[::10]]
    for n in (250, 550):
        some = [" ".join(t) for t in texts[-n:]]
        count, found = candidates(spark, monkeypatch, some)
        verified.append(count)
        sets = [shingles(t) for t in some]
        assert all(found[i] == found[j] for j in range(n) for i in range(j) if similar(sets[i], sets[j]))
    assert verified[1] < 40 * 550  # all pairs would be 150,000


def test_members_meet_once(spark, monkeypatch):
    """Copies edited too much, each with a partner that has the same edits and one more: two members meet on one shingle under one centre, not on all they share."""
    draw, rows = random.Random(9), []
    page = [f"t{draw.randrange(10**6)}" for _ in range(150)]

    def edit(words, n):
        out = list(words)
        for k in draw.sample(range(len(out)), n):
            out[k] = f"e{draw.randrange(10**6)}"
        return out

    texts = [edit(page, 3) for _ in range(120)]
    texts = [" ".join(t) for t in texts + [edit(t, 1) for t in texts]]
    plain = near_copies._ordered
    # the join's rows before they are made distinct, of those that aren't stars
    monkeypatch.setattr(near_copies, "_ordered", lambda pairs, x, y: (rows.append((pairs.count(), plain(pairs, x, y).count())), plain(pairs, x, y))[1])
    _, found = candidates(spark, monkeypatch, texts)
    sets = [shingles(t) for t in texts]
    assert all(found[i] == found[j] for j in range(240) for i in range(j) if similar(sets[i], sets[j]))
    made, different = rows[-1]
    assert 0 < made <= 1.1 * different
