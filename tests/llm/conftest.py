import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("", "ra", "sto", "lin")]


@pytest.fixture(scope="session")
def texts():
    """Plain and odd texts: copies, near copies, shared passages, nulls, blanks, ties, a long one, other scripts."""
    draw = random.Random(11)
    say = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    base = [say(draw.randint(5, 160)) for _ in range(25)]
    passage = say(60)
    out = [*base, base[0], base[0], base[1] + " extra", "x" + base[2], base[3].upper()]
    for k in range(6):
        at = base[k + 5].split()
        out.append(" ".join([*at[: k * 3], passage, *at[k * 3 :]]))
    words = base[10].split()
    for k in (0, len(words) // 2, len(words) - 1):
        out.append(" ".join([*words[:k], "changed", *words[k + 1 :]]))
    out += [None, "", " \t\n ", "one", "two words", "a" * 900, "ab" * 700, "a" * 900 + "b", say(3000), f"{passage} {passage}", "été ¿qué? naïve 日本語 текст 🙂 " * 20]
    out += ["line\nline\n\nline \nother\r\nother", "# * $ % & | < > #", "a b c\x0bd", "<|endoftext|> don't  I'LL 12345 <|startoftext|>"]
    out += [f"{passage}\n{say(30)}", f"{say(34)} {' '.join(passage.split()[:34])}", f"{say(10)} {' '.join(passage.split()[5:45])} {say(10)}"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids (one null, one used twice), and columns whose names operators use inside."""
    rows = []
    for k, t in enumerate(texts):
        ident = None if k == 7 else 3 if k == 8 else k
        rows.append((ident, t, ("en", "de", None)[k % 3], "hot" if k % 3 else f"s{k % 5}" if k % 2 else None, None if k % 4 == 0 else len(t or ""), k, "row", 1))
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, node long, row string, tokens int"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(k, None if k == 5 else int(k % 4 != 0), int(k % 7 == 0)) for k in range(0, len(texts), 2)] + [(999_999, 1, 0), (None, 1, 1), (2, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
