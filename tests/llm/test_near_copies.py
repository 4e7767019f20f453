"""Near copies held against all pairs: groups larger than a small bucket, and copies that are cut, extended or replaced in one place."""

import random

import numpy as np
import pytest
from helpers import frame, lower, text, words

from shopfloor.llm import set_join, simhash


def shingles(t):
    w = words(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def kept(docs, t=0.8):
    """Least id of every group that similar pairs link."""
    sets = [shingles(x) for _, x in docs]
    least = list(range(len(docs)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def found(spark, docs):
    return sorted(r["doc_id"] for r in simhash.near_duplicates(frame(spark, docs)).collect())


def tight_triples(rnd, first, groups=6):
    """Triples that differ in the last word only; the triples of a group are about 0.81 alike."""
    base = words(text(rnd, 200, 10**6))
    docs = []
    for g in range(groups):
        w = list(base)
        for at in (20 + 25 * g, 30 + 25 * g):
            w[at] = f"g{g}x{at}"
        docs += [(first + 3 * g + k, " ".join(w[:-1] + [f"end{g}{k}"])) for k in range(3)]
    return docs


def test_triples_of_a_large_bucket_are_linked(spark):
    docs = tight_triples(random.Random(1), 100)
    assert kept(docs) == [100]
    assert found(spark, docs) == [100]


def test_loose_group_with_chains(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 16)
    rnd = random.Random(2)
    base = words(text(rnd, 120, 10**6))
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randrange(1, 6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    want = kept(docs)
    assert 1 < len(want) < 150
    assert found(spark, docs) == want


@pytest.mark.parametrize("size", [60, 400])
def test_contiguous_edits(spark, size):
    rnd = random.Random(size)
    docs, at_least = [], 0
    for i in range(0, 240, 2):
        w = words(text(rnd, size, 10**6))
        n = size - 4
        goal = rnd.uniform(0.79, 0.86)
        new = words(text(rnd, size, 10**6))
        how = i // 2 % 4
        if how == 0:
            copy = w[: round(goal * n) + 4]
        elif how == 1:
            copy = w + new[: round(n / goal) - n]
        elif how == 2:
            copy = w[-(round(goal * n) + 4) :]
        else:
            m = max(1, round((1 - goal) / (1 + goal) * n) - 4)
            copy = w[:20] + new[:m] + w[20 + m :]
        docs += [(i, " ".join(w)), (i + 1, " ".join(copy))]
        at_least += similarity(shingles(docs[-2][1]), shingles(docs[-1][1])) >= 0.8
    want = kept(docs)
    assert at_least > 60 and len(want) == len(docs) - at_least
    assert found(spark, docs) == want


def test_similar_sets_share_a_key_that_does_not_rule_them_out():
    rnd = random.Random(3)
    for _ in range(3000):
        n = rnd.randrange(1, 60)
        a = set(rnd.sample(range(200), n))
        b = {x for x in a if rnd.random() > 0.1} | set(rnd.sample(range(200), rnd.randrange(0, 1 + n // 8))) or {1}
        if len(a & b) < 0.8 * len(a | b):
            continue
        entries = [[(x, i, i, p, len(s)) for p, x in enumerate(sorted(s)[: len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1])] for i, s in enumerate((a, b))]
        u, _, _ = set_join._first_pairs(np.array(entries[0] + entries[1], dtype=set_join.ENTRY), 0.8)
        assert len(u)


def test_wide_bitmaps_fold_and_never_exceed_the_difference_of_sets():
    rnd = np.random.default_rng(5)
    sizes = (1000, 1500, 3000, 3500, 9000)
    base = rnd.integers(-(2**62), 2**62, 20_000)
    sets = [np.unique(np.concatenate([base[: n - 200], rnd.integers(-(2**62), 2**62, 200)])) for n in sizes]
    sets.append(np.unique(rnd.integers(-(2**62), 2**62, 3000)))
    flat, n = np.concatenate(sets), np.array([len(s) for s in sets])
    wide = set_join._wide_bitmaps(flat, n)
    assert [len(x) * 8 if x else 0 for x in wide] == [0, 2048, 4096, 4096, 16384, 4096]
    narrow = np.frombuffer(wide[4], np.uint64).reshape(-1, 32)
    assert (np.bitwise_xor.reduce(narrow, axis=0) == set_join._bitmaps(sets[4], n[4:5], 32)[0]).all()
    a, b = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    got = set_join._wide_allow(a, b, wide, n, 0.8)
    for i, j, ok in zip(a, b, got):
        both = len(np.intersect1d(sets[i], sets[j]))
        alike = both / (n[i] + n[j] - both)
        assert ok or alike < 0.8
        if 0 not in (i, j) and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]):
            assert not ok or alike > 0.6


def test_long_texts_of_many_lengths(spark):
    rnd = random.Random(9)
    docs, base = [], words(text(rnd, 4000, 10**6))
    for g in range(12):
        own = words(text(rnd, 2600, 10**6))
        shared = base[: 1000 + 200 * (g % 4)]
        docs.append((10 * g, " ".join(shared + own)))
        docs.append((10 * g + 1, " ".join(shared + own[: 2600 - 60 * g])))
    assert found(spark, docs) == kept(docs)
