"""Golay code, Elias-Fano sequences, tries and array helpers."""

import random

import numpy as np
import pyarrow as pa
from helpers import words

from shopfloor.llm import arrays, blocks, elias_fano, golay, packing
from shopfloor.llm.components import connected_components


def test_words_that_differ_in_two_bits_share_an_index():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 23, 3000).astype(np.uint32)
    y = x.copy()
    for k in range(3000):
        for p in random.Random(k).sample(range(23), k % 3):
            y[k] ^= np.uint32(1 << p)
    assert all(set(a) & set(b) for a, b in zip(golay.nearby(x).tolist(), golay.nearby(y).tolist()))


def test_elias_fano_and_trie():
    rnd = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (1, 1 << 40), (1000, 1000), (1000, 1 << 33), (5000, 1 << 16)):
        v = np.sort(rnd.integers(0, u, n).astype(np.uint64))
        s = elias_fano.Sequence(elias_fano.encode(v, u))
        assert (s.get(np.arange(n)) == v).all()
        q = np.concatenate([v, rnd.integers(0, u, 300).astype(np.uint64), np.array([0, u - 1], np.uint64)])
        at, found = s.successor(q)
        assert (found == np.isin(q, v)).all() and (at[found] == np.searchsorted(v, q)[found]).all()
    keys = np.unique(rnd.integers(0, 300, 20000).astype(np.uint64) << np.uint64(32) | rnd.integers(0, 5000, 20000).astype(np.uint64))
    context, token = keys >> np.uint64(32), keys & np.uint64((1 << 32) - 1)
    codes = rnd.integers(0, 60000, len(keys)).astype(np.uint16)
    known = dict(zip(keys.tolist(), codes.tolist()))
    with elias_fano.mapped(elias_fano.Trie.build(context, token, codes)) as levels:
        trie = elias_fano.Trie(levels)
        c, t = rnd.integers(0, 320, 5000).astype(np.uint64), rnd.integers(0, 9000, 5000).astype(np.uint64)
        got = trie.lookup(c, t, 65535).tolist()
        del trie
    assert got == [known.get(k, 65535) for k in (c << np.uint64(32) | t).tolist()]


def test_words_of_arrays():
    texts = ["", None, "a b  c\n\td", "xéé  y", " lead trail ", "\x0b\x0c", "b c", "x y z" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for limit in (1, 7, 1000):
        got = []
        for rows, data, offsets in arrays.chunks([batch], "text", limit):
            starts, ends, of = arrays.word_bounds(data, offsets)
            raw = data.tobytes()
            own = [[] for _ in range(len(rows))]
            for a, b, i in zip(starts, ends, of):
                own[i].append(raw[a:b].decode())
            got += own
        assert got == [words(t) for t in texts]


def test_hashes_tell_structured_slices_apart():
    def morse(bits, one, zero):
        return "".join(one if bin(i).count("1") % 2 else zero for i in range(1 << bits))

    made = [morse(10, x, y) for x, y in ("ab", "ba")] + [morse(7, x, y) for x, y in ("ab", "ba")] + ["a" * n for n in range(1, 300)] + [chr(97 + i) + "\0" * j for i in range(9) for j in range(9)]
    raw = np.frombuffer("".join(made).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in made])
    h = arrays.slice_hashes(raw, ends - [len(x) for x in made], ends)
    by = {}
    for x, y in zip(made, h.tolist()):
        by.setdefault(y, set()).add(x)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(made))
    assert (arrays.slice_hashes(raw[5:], np.zeros(1, np.int64), np.array([3])) == arrays.slice_hashes(raw[5:8], np.zeros(1, np.int64), np.array([3]))).all()
    values = np.array([1 if bin(i).count("1") % 2 else 2 for i in range(4096)], np.uint64)
    for n in (1, 2, 5, 13, 50, 64, 1024):
        w = arrays.window_hashes(values, n)
        names = {}
        for i, x in enumerate(w.tolist()):
            assert names.setdefault(x, tuple(values[i : i + n].tolist())) == tuple(values[i : i + n].tolist())
        assert len(w) == 4097 - n and len(names) == len({tuple(values[i : i + n].tolist()) for i in range(4097 - n)})
    assert len(arrays.window_hashes(values[:3], 4)) == 0


def test_blocks_pack():
    body = {"a": np.arange(5, dtype=np.uint32), "b": np.zeros(0), "c": np.array([True, False])}
    back = blocks.unpack(blocks.pack(body))
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in body.items())


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    used = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in used}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_packing(sizes, sources, clusters, capacity):
    bins, out = [], []
    for row, (n, s, c) in enumerate(zip(sizes, sources, clusters)):
        for length in [capacity] * (n // capacity) + [n % capacity] * bool(n % capacity):
            fits = [(capacity - b["used"] - length, i) for i, b in enumerate(bins) if b["used"] + length <= capacity and b["used"] < capacity and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
            if fits:
                i = min(fits)[1]
            else:
                bins.append({"used": 0, "s": set(), "c": set()})
                i = len(bins) - 1
            out.append((row, i, bins[i]["used"], length))
            bins[i]["used"] += length
            bins[i]["s"].add(s)
            bins[i]["c"].add(c)
    return out


def test_best_fit_equals_a_plain_search():
    rnd = random.Random(3)
    for _ in range(20):
        n = rnd.randrange(0, 120)
        sizes = sorted((rnd.randrange(1, 150) for _ in range(n)), reverse=True)
        sources = [rnd.choice([None, 0, 0, 0, 1, 2, 3, 4]) for _ in range(n)]
        clusters = [rnd.choice([None, *range(30)]) for _ in range(n)]
        assert packing.pack_group(sizes, sources, clusters, 64) == plain_packing(sizes, sources, clusters, 64)
