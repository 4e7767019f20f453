"""Links between texts whose sets of word shingles have a Jaccard similarity of t or more, by prefix filtering.

All shingles have one order, rare ones first.  Two sets of similarity t or more share one of the first n - ceil(t n) + 1
shingles of each (n: size of the set), so these are the keys of a set and no such pair is missed, whatever the order; the
order, from a sample, only decides how much is compared.  At the first key that a pair shares, the places of the key
bound the overlap from above, and pairs below the need of t go.

Links that are known before (of near fingerprints) are tested first and join what they can.  Of the pairs of a key,
only those that are still in two components are tested: first those in small buckets and those with the members of a
large bucket that have fewest rare shingles, then every pair of a large bucket, block against block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .blocks import split
from .components import connected_components
from .scratch import materialize

SMALL = 6  # in a bucket of up to this many sets, all pairs are tested at once
BROADCAST_ROWS = 1_000_000  # rows of a few numbers that may be broadcast
PIVOTS = 4  # members of a larger bucket that are tested against all others first
BLOCK = 2048  # members of a large bucket that one task takes from either side
LEAST_BLOCKS = 16  # parts of the nodes, whose pairs are the units of testing
PER_SHARD = 1_000_000  # keys that one task looks through, about
KNOWN = 200_000  # shingles whose count in the sample is known to the order
TABLES = 2  # fingerprints of a set, by different hashes
WORDS = 16  # 64-bit words of a set's parity bitmap; sets of more members than its bits have a wide one besides
FOLD_WORDS = 1 << 21  # words of wide bitmaps that are compared at once
ENTRY = [("key", "<i8"), ("node", "<i8"), ("label", "<i8"), ("pos", "<i4"), ("n", "<i4")]
EPS = 1e-9


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words per text, distinct shingle hashes text by text in ascending order, and their number per text.

    A text of fewer than ``k`` words has one shingle, all of it.  ``key`` is the secret of one run, so that nobody can make
    two words alike.
    """
    data = arrays.lower_ascii(data)
    starts, ends, of = arrays.word_bounds(data, offsets)
    h = arrays.slice_hashes(data, starts, ends, key)
    rows = len(offsets) - 1
    n = np.bincount(of, minlength=rows)
    stop = np.cumsum(n)
    count = np.maximum(n - k + 1, 1)
    first = np.repeat(stop - n, count) + arrays.ranges(count)
    owner = np.repeat(np.arange(rows), count)
    s = np.zeros(len(owner), dtype=np.int64)
    whole = n[owner] < k
    s[~whole] = arrays.window_hashes(h, k)[first[~whole]].view(np.int64)
    short = np.flatnonzero(n < k)
    s[whole] = arrays.row_digests(h[n[of] < k], n[short])[0]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return h, n, s[fresh], np.bincount(owner[fresh], minlength=rows)


def _bitmaps(flat: np.ndarray, n: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Parity bitmaps of sets: two differ in no more bits than the sets have members in one only."""
    bit = arrays.mixed(flat.view(np.uint64)) % np.uint64(64 * words)
    cell, times = np.unique(np.repeat(np.arange(len(n)), n) * (64 * words) + bit.astype(np.int64), return_counts=True)
    cell = cell[times % 2 == 1]
    out = np.zeros(len(n) * words, dtype=np.uint64)
    np.bitwise_or.at(out, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
    return out.reshape(-1, words)


def _wide_bitmaps(flat: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """Bitmaps of at least a bit a member for the sets that ``WORDS`` words cannot tell apart; None for the others.

    Half full, a bitmap allows every pair; this is so from about two members a bit.  Widths are powers of two, so that a
    wide bitmap folds to a narrower one.
    """
    out: list[bytes | None] = [None] * len(n)
    width = np.array([1 << (int(x) - 1).bit_length() >> 6 if x > 64 * WORDS else 0 for x in n], dtype=np.int64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        for i, bits in zip(at.tolist(), _bitmaps(flat[np.repeat(width == w, n)], n[at], w)):
            out[i] = bits.tobytes()
    return out


def _wide_allow(a: np.ndarray, b: np.ndarray, wide: list[bytes | None], n: np.ndarray, t: float) -> np.ndarray:
    """Whether sets ``a`` and ``b`` can be similar by their wide bitmaps, the wider folded to the other; true if one has none."""
    width = np.array([len(x) // 8 if x else 0 for x in wide], dtype=np.int64)
    least = np.minimum(width[a], width[b])
    out = np.ones(len(a), dtype=bool)
    for w in np.unique(least[least > 0]).tolist():
        own = np.flatnonzero(least == w)
        nodes, at = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(wide[x], dtype=np.uint64).reshape(-1, w), axis=0) for x in nodes.tolist()])
        step = max(1, FOLD_WORDS // w)
        for i in range(0, len(own), step):
            part, p, q = own[i : i + step], at[i : i + step][: len(own) - i], at[len(own) + i : len(own) + i + step]
            out[part] = _bits_allow(bits[p], bits[q], n[a[part]] + n[b[part]], t)
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def common_shingles(rows: DataFrame, k: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of ``rows(text_hash, text)``, in ascending order, and their counts."""
    total = rows.count()
    every = max(1, total // (5000 + total // 100))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in arrays.chunks(batches, "text"):
            s, c = np.unique(shingle_sets(data, offsets, k, key)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c.astype(np.int64))], ["s", "c"])

    seen = rows.where(F.pmod("text_hash", F.lit(every)) == 0).select("text").mapInArrow(run, "s long, c long")
    top = seen.groupBy("s").agg(F.sum("c").alias("c")).where("c > 1").orderBy(F.desc("c"), "s").limit(KNOWN).toPandas()
    s, c = top["s"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], c[order]


def named_keys(rows: DataFrame, t: float, k: int, key: int, fingerprint: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(doc_id, text_hash, cls, cls2, n, keys, bits, wide, fp)``: two names of the word sequence; size, keys in order, bitmaps and ``TABLES`` fingerprints of the shingle set."""
    known, counts = common_shingles(rows, k, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.chunks(batches, "text"):
            h, words, s, n = shingle_sets(data, offsets, k, key)
            names = arrays.row_digests(h, words)
            bits, wide = _bitmaps(s, n), _wide_bitmaps(s, n)
            fps = [fingerprint(arrays.mixed(s.view(np.uint64) + np.uint64(i)), n).view(np.int64) for i in range(TABLES)]
            rank = np.zeros(len(s), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                rank = np.where(known[at] == s, counts[at], 0)
            s = s[np.lexsort((s, rank, np.repeat(np.arange(len(n)), n)))]
            prefix = n - np.ceil(t * n - EPS).astype(np.int64) + 1
            keys = s[arrays.ranges(n) < np.repeat(prefix, n)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names[0]), pa.array(names[1]), pa.array(n.astype(np.int32)), _lists(keys, np.minimum(prefix, n)), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(wide, pa.binary()), _lists(np.stack(fps, axis=1).ravel(), np.full(len(n), TABLES))], ["doc_id", "text_hash", "cls", "cls2", "n", "keys", "bits", "wide", "fp"])

    return rows.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, cls long, cls2 long, n int, keys array<long>, bits binary, wide binary, fp array<long>")


def _need(total, t: float):
    """The least overlap of two sets of similarity ``t`` with ``total`` members together."""
    return np.ceil(t / (1 + t) * total - EPS)


def _possible(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Whether entries of one key can belong to sets of similarity ``t``, if it is the first key that they share."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return (np.maximum(na, nb) * t <= np.minimum(na, nb) + EPS) & (np.minimum(na - a["pos"], nb - b["pos"]) >= _need(na + nb, t))


def _blobs(u: np.ndarray, v: np.ndarray, blocks: int) -> pd.DataFrame:
    """Distinct pairs by the blocks of their ends: ``(bu, bv, pairs)``."""
    bu, bv = ((arrays.mixed(x.view(np.uint64)) % np.uint64(blocks)).astype(np.int64) for x in (u, v))
    swap = (bu > bv) | ((bu == bv) & (u > v))
    u, v, bu, bv = np.where(swap, v, u), np.where(swap, u, v), np.where(swap, bv, bu), np.where(swap, bu, bv)
    own = np.unique(np.stack([bu * blocks + bv, u, v], axis=1), axis=0) if len(u) else np.zeros((0, 3), np.int64)
    cells, starts = np.unique(own[:, 0], return_index=True)
    made = [np.ascontiguousarray(x[:, 1:]).tobytes() for x in np.split(own, starts[1:])] if len(own) else []
    return pd.DataFrame({"bu": cells // blocks, "bv": cells % blocks, "pairs": pd.Series(made, dtype=object)})


def _first_pairs(e: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the entries of some keys: ends of the pairs to test first, and the entries of large buckets with several labels."""
    e = e[np.argsort(e["key"], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1], [True]])) if len(e) else np.zeros(1, np.int64)
    size = np.diff(edge)
    each = np.repeat(size, size)
    us, vs, large = [], [], []
    some = e[(each > 1) & (each <= SMALL)]
    for off in range(1, SMALL):
        a, b = some[:-off], some[off:]
        hit = (a["key"] == b["key"]) & (a["label"] != b["label"]) & _possible(a, b, t)
        us.append(a["node"][hit])
        vs.append(b["node"][hit])
    for i in np.flatnonzero(size > SMALL):
        bucket = e[edge[i] : edge[i + 1]]
        _, where, count = np.unique(bucket["label"], return_inverse=True, return_counts=True)
        if len(count) == 1:
            continue
        large.append(bucket)
        # Members of the largest component with few rare shingles: many others are like them, for other keys too.
        order = np.lexsort((arrays.mixed(bucket["node"].astype(np.int64).view(np.uint64)), bucket["pos"] / bucket["n"], -count[where]))
        for p in order[:PIVOTS]:
            hit = bucket[_possible(bucket, bucket[p : p + 1], t) & (bucket["label"] != bucket["label"][p])]["node"]
            us.append(np.full(len(hit), bucket["node"][p]))
            vs.append(hit)
    u, v = (np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64) for x in (us, vs))
    return u, v, np.concatenate(large) if large else e[:0]


def _cross(a: np.ndarray, la: np.ndarray, xa: np.ndarray, b: np.ndarray, lb: np.ndarray, xb: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an entry of ``a`` and one of ``b`` that can be similar by places and bitmaps and have different labels."""
    for at in range(0, len(a), 256):
        x = a[at : at + 256]
        i, j = np.nonzero((la[at : at + 256][:, None] != lb[None, :]) & _possible(x[:, None], b[None, :], t))
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = _bits_allow(xa[at + p], xb[q], x["n"][p].astype(np.int64) + b["n"][q], t)
            yield x["node"][p[near]], b["node"][q[near]]


def _bits_allow(x: np.ndarray, y: np.ndarray, total: np.ndarray, t: float) -> np.ndarray:
    """Whether sets with these bitmaps and ``total`` members together can be similar."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= total - 2 * _need(total, t)


def _spanning(u: np.ndarray, v: np.ndarray, label: np.ndarray, flat: np.ndarray, n: np.ndarray, t: float) -> list[tuple[int, int]]:
    """Of the pairs of set numbers ``(u, v)``, nearest by bitmap first, the similar ones whose ends are not linked already."""
    ends = np.cumsum(n)
    bits = _bitmaps(flat, n)
    d = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
    order = np.argsort(d, kind="stable")
    near = np.stack([u[order], v[order]], axis=1)
    parent = np.unique(label, return_inverse=True)[1].tolist()
    top = list(range(len(n)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in near.tolist():
        x, y = find(parent[a]), find(parent[b])
        if x == y:
            continue
        common = len(np.intersect1d(flat[ends[a] - n[a] : ends[a]], flat[ends[b] - n[b] : ends[b]], assume_unique=True))
        if common >= t * (int(n[a]) + int(n[b]) - common):
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _members(pairs: DataFrame) -> DataFrame:
    """``(bu, bv, node)``: the ends of the pairs of each two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bu, bv, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ends = np.unique(np.frombuffer(body, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), bu)), pa.array(np.full(len(ends), bv)), pa.array(ends)], ["bu", "bv", "node"])

    return pairs.select("bu", "bv", "pairs").mapInArrow(run, "bu long, bv long, node long").distinct()


def _ends(pdf: pd.DataFrame) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in pdf["pairs"]] or [np.zeros((0, 2), np.int64)]), axis=0)


def _matrix(bits: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(-1, WORDS)


def _labels(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add ``label``, the component of a node so far."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _tested(pairs: DataFrame, nodes: DataFrame, sets_of, labels: DataFrame | None, t: float) -> DataFrame:
    """``(u, v)``: similar pairs of ``pairs(bu, bv, pairs)`` that span all that is similar in each two blocks.

    Labels and bitmaps rule out most pairs before any set is read.
    """

    def rule_out(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("node", ignore_index=True)
        node, n, label = (right[c].to_numpy(np.int64) for c in ("node", "n", "label"))
        bits, wide = _matrix(right["bits"]), [x if isinstance(x, bytes) else None for x in right["wide"].tolist()]
        ends = _ends(left)
        at, near = np.searchsorted(node, ends).reshape(-1, 2), np.zeros(len(ends), dtype=bool)
        for i in range(0, len(at), 1 << 16):
            a, b = at[i : i + (1 << 16)].T
            near[i : i + (1 << 16)] = _bits_allow(bits[a], bits[b], n[a] + n[b], t) & (label[a] != label[b])
        sizes = n[at]
        near &= sizes.max(axis=1) * t <= sizes.min(axis=1) + EPS
        left_over = np.flatnonzero(near)
        near[left_over] = _wide_allow(at[left_over, 0], at[left_over, 1], wide, n, t)
        return pd.DataFrame({"bu": left["bu"][:1], "bv": left["bv"][:1], "pairs": [ends[near].tobytes()]})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.drop_duplicates("node").sort_values("node", ignore_index=True)
        node = right["node"].to_numpy(np.int64)
        flat = np.concatenate(right["s"].tolist() or [np.zeros(0, np.int64)]).astype(np.int64)
        at = np.searchsorted(node, _ends(left))
        good = _spanning(at[:, 0], at[:, 1], right["label"].to_numpy(np.int64), flat, right["s"].map(len).to_numpy(np.int64), t)
        good = node[np.array(good, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"u": good[:, 0], "v": good[:, 1]})

    light = _labels(_members(pairs).join(nodes.select("node", "n", "bits", "wide"), "node"), labels)
    near = pairs.groupBy("bu", "bv").cogroup(light.groupBy("bu", "bv")).applyInPandas(rule_out, "bu long, bv long, pairs binary")
    near = materialize(near.where("length(pairs) > 0"))
    members = materialize(_labels(_members(near), labels))
    sets = sets_of(members.select("node").distinct())
    few = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    return near.groupBy("bu", "bv").cogroup(sets.join(few, "node").select("bu", "bv", "node", "label", "s").groupBy("bu", "bv")).applyInPandas(run, "u long, v long")


def _dealt(links: DataFrame, blocks: int) -> DataFrame:
    """``(bu, bv, pairs)`` from ``links(u, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pandas(_blobs(u, v, blocks), pa.schema([("bu", pa.int64()), ("bv", pa.int64()), ("pairs", pa.binary())]), preserve_index=False)

    return links.select("u", "v").mapInArrow(run, "bu long, bv long, pairs binary")


def similar_components(nodes: DataFrame, sets_of, t: float, links: DataFrame) -> DataFrame:
    """``(node, component)`` of all ``nodes(node, n, keys, bits, wide)`` that a chain of pairs of similarity ``t`` links to another.

    ``links(u, v)`` are tested first; whatever they miss is found by the keys.

    ``sets_of`` takes a table of nodes and gives ``(node, s)``, their shingle sets in ascending order; a node may come more than once.
    """
    count, keys = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    shards = max(8, keys // PER_SHARD)
    blocks = max(LEAST_BLOCKS, int((count / 2000) ** 0.5))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            per = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            e = np.empty(int(per.sum()), dtype=ENTRY)
            e["key"] = lists.flatten().to_numpy(zero_copy_only=False)
            for i, c in enumerate(("node", "label", "n")):
                e[c] = np.repeat(batch.column(i).to_numpy(zero_copy_only=False), per)
            e["pos"] = arrays.ranges(per)
            to = (arrays.mixed(e["key"].astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            out = [(s, e[i].tobytes()) for s, i in split(to, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["shard", "body"])

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, large = _first_pairs(np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in pdf["body"]]), t)
        made = _blobs(u, v, blocks)
        return pd.concat([made.assign(entries=None), pd.DataFrame({"bu": [-1], "bv": [-1], "pairs": [None], "entries": [large.tobytes()]})], ignore_index=True)

    kept = ["key", "node", "pos", "n"]

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                e = np.frombuffer(body, dtype=ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[c])) for c in kept], kept)

    def rest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (_, i, j), g in pdf.groupby(["key", "i", "j"], sort=False):
            e = np.empty(len(g), dtype=ENTRY)
            for c in [*kept, "label"]:
                e[c] = g[c]
            label, salt, bits = e["label"], g["salt"].to_numpy(), _matrix(g["bits"])
            a, b = salt == i, salt == j
            for u, v in _cross(e[a], label[a], bits[a], e[b], label[b], bits[b], t):
                us.append(u)
                vs.append(v)
        return _blobs(np.concatenate(us).astype(np.int64), np.concatenate(vs).astype(np.int64), blocks)

    good = materialize(_tested(_dealt(links, blocks), nodes, sets_of, None, t))
    linked = materialize(connected_components(good))
    known = F.broadcast(linked) if linked.count() <= BROADCAST_ROWS else linked
    sent = _labels(nodes.select("node", "n", "keys"), known).select("node", "label", "n", "keys").mapInArrow(send, "shard int, body binary")
    found = materialize(sent.groupBy("shard").applyInPandas(first, "bu long, bv long, pairs binary, entries binary"))
    pairs = found.where("pairs is not null").select("bu", "bv", "pairs")
    large = found.where("length(entries) > 0").select("entries").mapInArrow(unpacked, "key long, node long, pos int, n int")
    by_key = materialize(_tested(pairs, nodes, sets_of, linked, t))
    if by_key.limit(1).count():
        good = good.unionByName(by_key)
        linked = materialize(connected_components(good))
    labelled = large.join(linked, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = materialize(labelled)
    apart = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    dealt = labelled.join(apart.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "key")
    dealt = dealt.join(nodes.select("node", "bits"), "node")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.withColumns({"i": F.least("salt", "o"), "j": F.greatest("salt", "o")}).withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(64, shards))))
    more = materialize(dealt.groupBy("shard").applyInPandas(rest, "bu long, bv long, pairs binary"))
    added = materialize(_tested(more, nodes, sets_of, linked, t))
    if not added.limit(1).count():
        return linked
    return connected_components(good.unionByName(added))
