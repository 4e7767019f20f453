"""Operator 12 against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import nasty

from shopfloor.llm import source_audit as audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, top=200, least=3):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, per_doc, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        found = TERM.findall(lower(text))
        groups[lang].add(source)
        counts[lang, source].update(found)
        per_doc[lang].update(set(found))
    out = set()
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, own in groups.items():
        kept = [t for t, n in per_doc[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in own}
        of_all = {t: sum(counts[lang, s][t] for s in own) for t in kept}
        q = {t: 1 + 10**9 * (of_all[t] + 1) // (sum(of_all.values()) + len(kept)) for t in kept}
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, x[2], -x[0], k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, x in enumerate(found)}
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = [f"wort{chr(97 + i % 26)}{'é' if i % 3 else 'X'}{chr(97 + i // 26)}" for i in range(90)]
    docs = [(None, None, None), ("", "", "leer"), ("1 2 3", "de", "ziffern"), ("Only Once here", "xx", "a"), (None, "xx", None)]
    for _ in range(n):
        lang = rnd.choice(["en", "de", None])
        docs.append((" ".join(rnd.choice(words[: rnd.randrange(2, 90)]) for _ in range(rnd.randrange(60))), lang, rnd.choice(["hot"] * 5 + ["b", "ü", "z", None])))
    return docs + docs[20:24] + [(t, "en", "hot") for _, t in nasty(seed)]


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n long, term string").repartition(3)


@pytest.mark.parametrize("cells", [audit.CELLS, 7])
def test_equals_the_plain_version(spark, monkeypatch, cells):
    monkeypatch.setattr(audit, "CELLS", cells)
    docs = corpus(cells % 5)
    rows = [tuple(r) for r in audit.audit(table(spark, docs)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(docs)


def test_joins_without_broadcast_and_small_ranks(spark, monkeypatch):
    monkeypatch.setattr(audit, "BROADCAST_GROUPS", 0)
    docs = corpus(9, 60)
    assert {tuple(r) for r in audit.audit(table(spark, docs), top=3).collect()} == plain(docs, top=3)


def test_empty_table(spark):
    assert audit.audit(table(spark, corpus(1)[:1]).limit(0)).count() == 0


def test_tree_shares_paths():
    rows = sorted([[(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 1)], [(0, 1), (1, 3)], [(1, 2), (2, 1)]])
    times = np.array([5, 2, 1, 4])
    flat = [x for r in rows for x in r]
    tree = audit.Tree(np.array([len(r) for r in rows]), np.array([s for s, _ in flat]), np.array([n for _, n in flat]), np.full(len(flat), 50), times)
    assert [tuple(map(list, tree.nodes(d))) for d in range(3)] == [([0, 3], [8, 4]), ([0, 2, 3], [7, 1, 4]), ([1], [2])]


def test_shares_are_exact_far_beyond_what_is_counted():
    n, whole = np.array([0, 10**14, 12345678901]), np.array([3, 10**15 + 7, 98765432109])
    assert audit._shares(n, whole).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), whole.tolist())]
