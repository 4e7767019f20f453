"""The corpus as dictionary-coded blocks, and the exchange of keyed values between blocks.

A block holds the tokens of some megabytes of consecutive rows: one array of distinct token hashes and one code
for every token.  Whatever has to be known about a key over the whole corpus (a count, a least document, a
piece count) goes through ``exchange``: each block sends a key once, however often it holds it, one task per
shard of the key space works on all blocks' keys, and each block gets its answers back.  A key that stands in a
third of all documents is so one entry per block, and no task holds more than its shard.

Blocks are written to the shared folder before they are used, so that a lost executor never changes them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .scratch import materialize

BLOCK = 8 << 20  # bytes of text in a block, about
PER_SHARD = 1_000_000  # keys that one task of an exchange works on, about
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others

Arrays = dict[str, np.ndarray]


def pack(body: Arrays) -> bytes:
    """Arrays as bytes: the bytes of equal rank of each array stand together, then zstandard."""
    turned = {k: (v.dtype.str, np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.itemsize).T.tobytes()) for k, v in body.items()}
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(turned, protocol=5))


def unpack(body: bytes) -> Arrays:
    turned = pickle.loads(zstandard.ZstdDecompressor().decompress(body))
    out = {}
    for k, (kind, raw) in turned.items():
        size = np.dtype(kind).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return out


def codes(body: Arrays) -> np.ndarray:
    """For every token, the place of its hash in ``words``."""
    return body["place"][body["rank"]]


def bags(body: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of bags: text number, place in the dictionary and frequency of every distinct token of every text."""
    kinds = body["kinds"]
    ends = np.cumsum(body["gap"], dtype=np.int64)
    first = np.cumsum(kinds) - kinds
    before = np.where(first > 0, ends[first - 1], 0) if len(ends) else first
    return np.repeat(np.arange(len(kinds)), kinds), body["place"][ends - np.repeat(before, kinds)], body["times"]


def distinct(hashes: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct pairs of hash and check, by hash: the place of a first one, and how many; and for each token its pair."""
    _, first, code, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if checks is None or np.array_equal(checks[first][code], checks):
        return first, count, code
    order = np.lexsort((checks, hashes))  # different words of one hash: hardly ever
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.cumsum(fresh) - 1
    return order[fresh], np.bincount(code), code


def build(
    docs: DataFrame,
    text: str = "text",
    lower: bool = False,
    cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]] = arrays.word_bounds,
    bag: bool = False,
    carry: tuple[str, ...] = (),
    digest: bool = False,
    checked: bool = False,
    key: int | None = None,
    extra: tuple[tuple[str, ...], Callable[[np.ndarray, np.ndarray], Arrays]] = ((), lambda data, offsets: {}),
) -> DataFrame:
    """``(block, n_keys, n_tokens, dict, body)``, written to the shared folder.

    The dictionary has ``words``, the sorted hashes of the distinct words, with ``key`` or a new key; with ``checked`` it also
    has ``checks``, 32 bits of second hashes by an independent key: together they are a word's 96-bit name, and a hash that
    several words share stands there once for each.  The body has ``ids`` (``doc_id`` as int64, null as ``NO_ID``),
    ``none`` (1 for a null id), ``lens`` (tokens per text), the int64 columns of ``carry``, with ``digest`` the two
    halves ``digest1`` and ``digest2`` of a 128-bit name of the text's tokens, what the function of ``extra`` gives for
    its names and each text, ``rank`` (each token's word by frequency, which compresses well) and ``place`` (where
    the word of a rank stands in ``words``).

    With ``bag`` the order of tokens is not kept: the dictionary has the tokens' bytes in ``chars`` and their
    ``sizes``, in the order of their hashes, and the body has, instead of ``rank``, what ``bags`` reads.
    """
    columns = ["doc_id", *carry]
    kept = ["ids", "none", "lens", *carry, *(["digest1", "digest2"] if digest else []), *extra[0]]
    key, second = arrays.new_key() if key is None else key, arrays.new_key()

    def finish(parts: list, n: int) -> pa.RecordBatch:
        hashes = np.concatenate([p["hash"] for p in parts])
        checks = np.concatenate([p["check"] for p in parts]) if checked or bag else None
        first, count, code = distinct(hashes, checks)
        words = hashes[first]
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        body = {"place": order.astype(np.uint32)}
        for name in kept:
            body[name] = np.concatenate([p[name] for p in parts])
        if bag:
            n_texts = len(body["lens"])
            pairs, times = np.unique(np.repeat(np.arange(n_texts), body["lens"]) * max(len(words), 1) + rank[code], return_counts=True)
            of, own = pairs // max(len(words), 1), pairs % max(len(words), 1)
            gap = np.diff(own, prepend=0)
            fresh = np.flatnonzero(np.diff(of, prepend=-1))
            gap[fresh] = own[fresh]
            body |= {"kinds": np.bincount(of, minlength=n_texts), "gap": gap.astype(np.uint32), "times": times.astype(np.uint32)}
            own, own_checks, sizes, chars = (np.concatenate([p[k] for p in parts]) for k in ("own", "own_checks", "own_sizes", "own_chars"))
            at = distinct(own, own_checks)[0]
            known = {"chars": chars[np.repeat((np.cumsum(sizes) - sizes)[at], sizes[at]) + arrays.ranges(sizes[at])], "sizes": sizes[at].astype(np.uint32)}
        else:
            body["rank"] = rank[code]
            known = {"words": words} | ({"checks": checks[first]} if checked else {})
        block = TaskContext.get().partitionId() << 32 | n
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([len(hashes)], pa.int64()), pa.array([pack(known)], pa.binary()), pa.array([pack(body)], pa.binary())], ["block", "n_keys", "n_tokens", "dict", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, n = [], 0, 0
        for rows, data, offsets in arrays.chunks(batches, text):
            data = arrays.lower_ascii(data) if lower else data
            starts, ends, of = cut(data, offsets)
            part = {"hash": arrays.slice_hashes(data, starts, ends, key), "lens": np.bincount(of, minlength=len(rows))}
            if checked or bag:
                part["check"] = (arrays.slice_hashes(data, starts, ends, second) >> np.uint64(32)).astype(np.uint32)
            for name in columns:
                value = rows.column(rows.schema.get_field_index(name)).cast(pa.int64())
                part["ids" if name == "doc_id" else name] = value.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
                if name == "doc_id":
                    part["none"] = value.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            part |= extra[1](data, offsets)
            if digest:
                part["digest1"], part["digest2"] = arrays.row_digests(part["hash"], part["lens"], part.get("check"))
            if bag:
                at = distinct(part["hash"], part["check"])[0]
                sizes = (ends - starts)[at]
                part |= {"own": part["hash"][at], "own_checks": part["check"][at], "own_sizes": sizes, "own_chars": data[np.repeat(starts[at], sizes) + arrays.ranges(sizes)]}
            parts.append(part)
            held += len(data)
            if held >= BLOCK:
                yield finish(parts, n)
                parts, held, n = [], 0, n + 1
        if parts:
            yield finish(parts, n)

    rows = docs.select(*columns, text)
    return materialize(rows.mapInArrow(run, "block long, n_keys long, n_tokens long, dict binary, body binary"))


def ids_of(body: Arrays) -> pd.Series:
    """The ids of a block's texts, null where they are."""
    return pd.Series(body["ids"], dtype="Int64").mask(body["none"].astype(bool))


def shards_for(keys: int) -> int:
    return max(12, -(-int(keys) // PER_SHARD))


def split(to: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Places of the entries of each shard that has any."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1))
    return [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s + 1] > cuts[s]]


def ranged(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards as equal ranges of hashes: for sorted keys, the answers of all shards in order are in the keys' order."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


Extract = Callable[[Arrays], tuple[np.ndarray, Callable[[np.ndarray], Arrays]]]
Reduce = Callable[[np.ndarray, list[Arrays]], tuple[list[Arrays], Arrays | None]]
COLUMNS = ("dict", "body")


def messages(block: int, keys: np.ndarray | None, to: np.ndarray, select: Callable[[np.ndarray], Arrays], shards: int) -> list[tuple[int, int, bytes]]:
    """``(shard, block, body)`` for each shard that gets anything; without keys only what ``select`` gives."""
    return [(s, block, pack(({} if keys is None else {"keys": keys[i]}) | select(i))) for s, i in split(to, shards)]


def exchange(blocks: DataFrame, extract: Extract, reduce: Reduce, shards: int, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``(block, shard, body)``: answers for the keys of every block, and at block -1 what a shard says for itself.

    ``extract`` gets the arrays of ``columns`` and gives the block's sorted keys, hashes in uint64, and a function
    that selects what goes with some of them.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, select = extract({k: v for c in columns for k, v in unpack(row[c]).items()})
                out = messages(row["block"], keys, ranged(keys, shards), select, shards)
                if out:
                    s, b, body = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.int64()), pa.array(body, pa.binary())], ["shard", "block", "body"])

    return answered(blocks.select("block", *columns).mapInArrow(send, "shard int, block long, body binary"), reduce)


def answered(sent: DataFrame, reduce: Reduce) -> DataFrame:
    """Answers to messages ``(shard, block, body)``.

    ``reduce(keys, parts)`` gets all blocks' keys of a shard, concatenated, and what came with them per block; it
    returns arrays per block, aligned with that block's keys, and anything more it has to say.
    """

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [unpack(b) for b in pdf["body"]]
        answers, own = reduce(np.concatenate([p["keys"] for p in parts if "keys" in p] or [np.zeros(0, np.uint64)]), parts)
        out = [(b, int(key[0]), pack(a)) for b, a in zip(pdf["block"], answers)]
        return pd.DataFrame(out + ([(-1, int(key[0]), pack(own))] if own is not None else []), columns=["block", "shard", "body"])

    return sent.groupBy("shard").applyInPandas(work, "block long, shard int, body binary")


def apart(values: np.ndarray, parts: list[Arrays]) -> list[np.ndarray]:
    """Values for concatenated keys, cut into those of each part."""
    return np.split(values, np.cumsum([len(p["keys"]) for p in parts])[:-1])


def joined(rows: pd.DataFrame) -> Arrays:
    """A block's answers ``(shard, body)`` in the order of its sorted keys."""
    bodies = [unpack(b) for b in rows.sort_values("shard")["body"]]
    return {k: np.concatenate([b[k] for b in bodies]) for k in (bodies[0] if bodies else ())}


def receive(blocks: DataFrame, answers: DataFrame, finish: Callable[[int, Arrays, pd.DataFrame], pd.DataFrame], schema: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Bring answers back: ``finish(block, arrays, rows)`` per block, with the rows of ``answers`` for it."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")})
        row = left.iloc[0]
        return finish(int(row["block"]), {k: v for c in columns for k, v in unpack(row[c]).items()}, right)

    back = answers.where("block >= 0")
    return blocks.select("block", *columns).groupBy("block").cogroup(back.groupBy("block")).applyInPandas(work, schema)


def total(blocks: DataFrame, column: str) -> int:
    return int(blocks.agg(F.sum(column)).first()[0] or 0)
