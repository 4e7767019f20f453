"""Fixtures and plain Python versions that the operators are held against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(t or "")


def text(rnd, n, size=300):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


def nasty(seed=0, n=60):
    """Ids with nulls and repeats; texts null, empty, blank, short, very long, with copies, near copies and passages."""
    rnd = random.Random(seed)
    passage = text(rnd, 70)
    long = text(rnd, 9000, 5000)
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, None), (None, "a b c d"), (5, long), (6, long), (7, "É É é ß 日本 " * 30), (8, "x " * 400), (9, "x y z " * 100)]
    for i in range(n):
        w = words(text(rnd, rnd.randrange(0, 120)))
        if i % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = words(passage)[rnd.randrange(10) :]
        docs.append((100 + i, rnd.choice([" ", "\n", "  "]).join(w)))
    base = words(text(rnd, 150))
    for i in range(8):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(99)}"
        docs.append((300 + i, " ".join(w)))
    docs += [docs[20], docs[20], (400, docs[20][1]), (401, (docs[20][1] or "").upper())]
    return docs


def structured():
    """Two different words of 1,024 letters whose polynomial hashes modulo a power of two are equal, side by side and apart."""
    x, y = ("".join(one if bin(i).count("1") % 2 else other for i in range(1024)) for one, other in ("ab", "ba"))
    return [(700, f"{x} {y}"), (701, x), (702, y), (703, f"so {x} {x} {y}.")]


def frame(spark, docs):
    """Documents with all columns, some null, and extra ones whose names the operators might use themselves."""
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), k, "x", 1.5) for k, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp string, key double").repartition(3)
