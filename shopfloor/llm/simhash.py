"""SimHash near-duplicates, linked through Golay-code keys, and near copies by their sets of shingles.

Rules for unusual input
-----------------------
null or empty text     fingerprint zero, linked like any other
very long text         hashed by itself, whole
null doc_id            fingerprinted and linked; a component's id is its least id that is not null
ties, repeated rows    each row is returned by itself; of equally old copies one stays
extra columns          ignored by ``fingerprints``; ``near_duplicates`` keeps them, unless they start with ``_dup_``
empty table            empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, golay, set_join
from .blocks import split
from .components import connected_components
from .scratch import materialize, working


#: Two of three segments of 64 bits hold at most 2 of 4 errors each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
SMALL = 6  # in a bucket of up to this many fingerprints, all pairs are compared
PER_SHARD = 2_000_000  # keys that one task looks through, about; with fewer, a text's fingerprints travel to more tasks
BROADCAST_ROWS = 1_000_000  # pairs of two numbers that may be broadcast


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of ``counts`` consecutive hashes, the bits that are set in over half of them; no hash: 0."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    sums = np.zeros((len(full), 64), dtype=np.int64)
    step = 1 << 17
    for a in range(0, len(hashes), step):
        part = np.unpackbits(hashes[a : a + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        b = a + len(part)
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
        cuts = np.concatenate([[a], ends[lo:hi]]) - a
        sums[lo : hi + 1] += np.add.reduceat(part, cuts, axis=0, dtype=np.int32)
    bits = np.packbits(2 * sums > counts[full][:, None], axis=1)
    out[full] = bits.view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the 64 majority bits of the XXH64 values of all word shingles, repeats included."""
    k = words_per_shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for rows, data, offsets in arrays.chunks(batches, text):
            starts, ends, of = arrays.word_bounds(data, offsets)
            joined, starts, ends = arrays.single_spaced(arrays.lower_ascii(data), starts, ends)
            n = np.bincount(of, minlength=len(rows))
            shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
            first = np.repeat(np.cumsum(n) - n, shingles) + arrays.ranges(shingles)
            last = first + np.repeat(np.minimum(n, k), shingles) - 1
            hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_majority(hashes, shingles).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, fp long")


def quick_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = 4) -> np.ndarray:
    """Fingerprints of texts like those of ``fingerprints``, from hashes of word hashes instead of XXH64."""
    starts, ends, of = arrays.word_bounds(data, offsets)
    words = arrays.slice_hashes(arrays.lower_ascii(data), starts, ends)
    n = np.bincount(of, minlength=len(offsets) - 1)
    short = (n > 0) & (n < k)
    count = np.where(short, 1, np.maximum(n - k + 1, 0))
    first = np.repeat(np.cumsum(n) - n, count) + arrays.ranges(count)
    whole = np.repeat(short, count)
    hashes = np.zeros(len(first), dtype=np.uint64)
    hashes[~whole] = arrays.window_hashes(words, k)[first[~whole]]
    hashes[whole] = arrays.row_digests(words[short[of]], n[short])[0].view(np.uint64)
    return _majority(hashes, count)


def _keys(fp: np.ndarray, segments, pairs) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each pair of segments: its number, the joined codeword indices, and the row each belongs to."""
    near = [golay.nearby((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in segments]
    rows = np.repeat(np.arange(len(fp)), 36)
    for p, (a, b) in enumerate(pairs):
        keys = (near[a][:, :, None] << np.uint32(12) | near[b][:, None, :]).reshape(len(fp), 36)
        keys.sort(axis=1)
        fresh = np.ones(keys.shape, dtype=bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        fresh = fresh.ravel()
        yield p, keys.ravel()[fresh], rows[fresh]


def _spanning(fp: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): links that join what is within ``radius`` bits in one bucket, each member reached once.

    Members next to the bucket's majority bits come first: many others are near them, so different buckets of one
    group mostly give the same links, and those between the most similar texts.
    """
    centre = _majority(fp, np.array([len(fp)]))[0]
    rest = np.lexsort((arrays.mixed(fp), np.bitwise_count(fp ^ centre)))
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        at = 0
        while at < len(frontier) and len(rest):
            i = frontier[at]
            at += 1
            close = np.bitwise_count(fp[rest] ^ fp[i]) <= radius
            if close.any():
                yield i, rest[close]
                frontier += rest[close].tolist()
                rest = rest[~close]


def _bucket_links(key: np.ndarray, row: np.ndarray, fps: np.ndarray, own: int, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between entries of equal key that differ in at most ``radius`` bits of table ``own``.

    An entry is a key and a row of ``fps`` and ``node``.
    """
    order = np.lexsort((fps[:, own][row], key))
    key, row = key[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    each = np.repeat(size, size)
    some = np.flatnonzero((each > 1) & (each <= SMALL))
    us, vs = [], []
    k, r = key[some], row[some]
    for off in range(1, SMALL):
        if len(k) <= off:
            break
        a, b = r[:-off], r[off:]
        hit = np.flatnonzero((k[off:] == k[:-off]) & (np.bitwise_count(fps[a, own] ^ fps[b, own]) <= radius))
        us.append(node[a[hit]])
        vs.append(node[b[hit]])
    for b in np.flatnonzero(size > SMALL):
        own_rows = row[edge[b] : edge[b + 1]]
        f = fps[own_rows]
        for i, js in _spanning(f[:, own], radius):
            us.append(np.full(len(js), node[own_rows[i]]))
            vs.append(node[own_rows[js]])
    return np.concatenate(us or [node[:0]]), np.concatenate(vs or [node[:0]])


def links(fps: DataFrame, radius: int = 4, segments=SEGMENTS, pairs=PAIRS, tables: int = 1) -> DataFrame:
    """``(u, v)``: links between nodes of ``fps(node, fp)`` that differ in at most ``radius`` bits in one of the tables.

    ``fp`` is an array of ``tables`` fingerprints.  Each segment is decoded to the indices of the codewords nearby and
    each pair of segments gives up to 36 joined keys of 24 bits.  Entries travel in blocks by key; a task compares
    the entries of each key and returns, for large buckets, links that span each group instead of all its pairs.
    """
    keys = fps.count() * 28 * len(pairs) * tables
    shards = 1 << max(2, (keys // PER_SHARD // (len(pairs) * tables)).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = batch.slice(at, 4000)
                node = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                fp = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(part), tables).view(np.uint64)
                out: dict[int, tuple[bytes, bytes]] = {}
                for t in range(tables):
                    for p, key, row in _keys(fp[:, t], segments, pairs):
                        to = (arrays.mixed(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                        for s, i in split(to, shards):
                            used, local = np.unique(row[i], return_inverse=True)
                            body = np.empty(len(i), dtype=[("key", "<u4"), ("row", "<u2")])
                            body["key"], body["row"] = key[i], local
                            out[(t * len(pairs) + p) * shards + s] = np.column_stack([fp[used].view(np.int64), node[used]]).tobytes(), body.tobytes()
                ids, bodies = zip(*out.values()) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())], ["shard", "ids", "body"])

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, rows, ids, at = [], [], [], 0
        for known, body in zip(pdf["ids"], pdf["body"]):
            body = np.frombuffer(body, dtype=[("key", "<u4"), ("row", "<u2")])
            known = np.frombuffer(known, dtype=np.int64).reshape(-1, tables + 1)
            keys.append(body["key"])
            rows.append(body["row"].astype(np.int32) + np.int32(at))
            ids.append(known)
            at += len(known)
        ids = np.concatenate(ids)
        own = int(key[0]) // (len(pairs) * shards)
        u, v = _bucket_links(np.concatenate(keys), np.concatenate(rows), np.ascontiguousarray(ids[:, :tables]).view(np.uint64), own, ids[:, tables].copy(), radius)
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"u": pair[:, 0], "v": pair[:, 1]})

    sent = fps.select("node", "fp").mapInArrow(send, "shard int, ids binary, body binary")
    return sent.groupBy("shard").applyInPandas(join, "u long, v long").distinct()


def labelled(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``(fp, label)`` for every distinct fingerprint of ``fps``: the least one of those that links lead to."""
    distinct = fps.select("fp").distinct()
    with working(fps.sparkSession):
        linked = connected_components(links(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), radius))
        return materialize(distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", F.coalesce("component", "fp").alias("label")), lasting=True)


def components(docs: DataFrame, text: str = "text", radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    fps = materialize(fingerprints(docs, text))
    named = labelled(fps, radius)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = named.join(least, "fp").groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(ids, "label").select("fp", "component_id"), "fp")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where a count has shown few rows; a shuffle join otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` but for those that copy another: of every group linked by copies, the least doc_id stays.

    Texts with equal words are one class.  Classes whose sets of word shingles have a Jaccard similarity of
    ``similarity`` or more are linked.  Candidates are classes of which one of two SimHash fingerprints differs in at most
    ``radius`` bits, found by their Golay keys; each link is verified on the sets.  Texts of 0.8 can differ in more bits than any radius
    of this kind takes, so ``set_join`` then finds every pair that would still join two groups.  Rows with null ids
    stay.  Equal rows of one id are copies of each other; of them one stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("doc_id is not null")
    with working(docs.sparkSession):
        key = arrays.new_key()
        marked = materialize(set_join.named_keys(rows, similarity, shingle, key, _majority))
        first = [F.min(c).alias(c) for c in ("n", "keys", "bits", "wide", "fp")]
        classes = marked.groupBy("cls", "cls2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *first)
        classes = materialize(classes.withColumnRenamed("cls", "node"))
        near = links(classes.select("node", "fp"), radius, tables=set_join.TABLES)
        linked = set_join.similar_components(classes, lambda nodes: _sets_of(rows, classes, nodes, shingle, key), similarity, near)
        named = classes.join(linked, "node", "left").select("rep", F.coalesce("component", "node").alias("label"))
        best = named.groupBy("label").agg(F.min("rep").alias("best")).select("best.doc_id", "best.text_hash")
        own = marked.select("doc_id", "text_hash")
        dropped = own.join(best, ["doc_id", "text_hash"], "left_anti").distinct()
        dropped = materialize(dropped.select(F.col("doc_id").alias("_dup_id"), F.col("text_hash").alias("_dup_hash")), lasting=True)
        repeats = own.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    small = _sized(dropped, dropped.count())
    kept = docs.join(small, (docs["doc_id"].cast("long") == small["_dup_id"]) & (F.xxhash64(docs[text]) == small["_dup_hash"]), "left_anti")
    if not repeats:
        return kept
    once = kept.where("doc_id is not null").dropDuplicates(["doc_id", text])
    return once.unionByName(kept.where("doc_id is null"))


def _sets_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int, key: int) -> DataFrame:
    """``(node, s)``: the shingle set of every one of ``nodes``, from the text that stands for its class; once per such row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in arrays.chunks(batches, "text"):
            _, _, s, n = set_join.shingle_sets(data, offsets, shingle, key)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(s))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "s"])

    wanted = materialize(classes.join(nodes, "node").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash")))
    texts = rows.join(_sized(wanted, wanted.count()), ["doc_id", "text_hash"]).select("node", "text")
    return texts.mapInArrow(run, "node long, s array<long>")


def op6_simhash_components(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
