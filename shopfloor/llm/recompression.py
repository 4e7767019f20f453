"""Removal of repeated passages, found by recompression.

A text is a sequence of symbols, at first its words.  Each Spark round writes runs of a symbol as one, then joins a
neighbour of the left class with one of the right class, and all blocks of the corpus agree in an exchange on the
names of the runs and pairs: a name is a number that a shard gives to exactly one run or pair, so equal passages
get the same symbols but at their edges.  For each symbol we keep the words that decide it: the ones it covers and
those that the rounds looked at beside it.

A window of words stands in two documents only if every symbol that its words decide does.  The shard knows the
documents of a run or pair, and one of a single document gets no name: windows that hold its deciding words are
out, and words without a window left leave the next round.  So the rounds shrink to what repeats, shared symbols of
the last round reveal it, and the windows there are verified by 128-bit hashes of their symbols' words.

Identity: a word is 96 bits of two hashes by secret keys of the run, so nobody can make two words alike; the first exchange gives
each such word a number of its own.  Runs and pairs of numbers are exact, a text or window is a 128-bit hash of its words.

Rules for unusual input
-----------------------
null or empty text     no words, nothing removed
very long text         one block by itself
null doc_id            comes after all ids: removes nothing elsewhere, loses what any id has (so does 2^63 - 1)
equal doc_ids, ties    rows of one id do not remove from one another
repeated rows          one result row each
extra columns          ignored
empty table            empty result
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, blocks
from .scratch import materialize

ROUNDS = 3
WINDOW = 50
_FAR = 1 << 40
_AWAY = 0xFF  # stands for _FAR in a stored state, as any distance that large
_ODD = np.uint64(0xD6E8FEB86659FD93)
PAIR = ("a", "k", "b", "l")  # k times a, then l times b; b and l are 0 for a run alone


def _joined(s: blocks.Arrays) -> np.ndarray:
    """For each symbol, whether the next one follows in the same stretch of words."""
    out = np.zeros(len(s["x"]), dtype=bool)
    if len(out):
        out[:-1] = (s["end"][:-1] == s["start"][1:]) & (s["stretch"][s["start"][:-1]] == s["stretch"][s["start"][1:]])
    return out


def meet(s: blocks.Arrays, salt: int) -> blocks.Arrays:
    """Runs and pairs of one round: ``a k b l``, the words ``start`` to ``end`` they cover and ``lo`` to ``hi`` that decide them.

    Beyond a stretch's end there is no symbol to look at: nothing inside a window decides what has looked there.
    """
    x, joined = s["x"], _joined(s)
    if not len(x):
        return {c: np.zeros(0, np.int64) for c in (*PAIR, "start", "end", "lo", "hi")}
    fresh = np.ones(len(x), dtype=bool)
    fresh[1:] = ~joined[:-1] | (x[1:] != x[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(x)) - 1
    a, k, follows = x[at], last - at + 1, joined[last]
    led = np.concatenate([[False], follows[:-1]])
    before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(x) - 1)
    lo, hi = np.minimum.reduceat(s["lo"], at), np.maximum.reduceat(s["hi"], at)
    lo = np.where(led, np.minimum(lo, s["lo"][before]), -_FAR)
    hi = np.where(led, np.maximum(hi, s["hi"][before]), hi)
    lo = np.where(follows, np.minimum(lo, s["lo"][after]), lo)
    hi = np.where(follows, np.maximum(hi, s["hi"][after]), _FAR)

    right = (arrays.mixed(a.view(np.uint64) ^ (k.astype(np.uint64) * _ODD + np.uint64(salt))) & np.uint64(1)).astype(bool)
    head = ~right & follows & np.append(right[1:], False)
    i = np.flatnonzero(~np.concatenate([[False], head[:-1]]))
    pair = head[i]
    j, p = np.minimum(i + 1, len(a) - 1), np.maximum(i - 1, 0)
    # A right-class symbol that stays has looked to its left, a left-class one or a pair's head to its right.
    other = np.where(right[i], p, j)
    there = np.where(right[i], led[i], follows[i])
    return {
        "a": a[i], "k": k[i], "b": np.where(pair, a[j], 0), "l": np.where(pair, k[j], 0),
        "start": s["start"][at[i]], "end": s["end"][last[np.where(pair, j, i)]],
        "lo": np.where(there, np.minimum(lo[i], lo[other]), np.where(right[i], -_FAR, lo[i])),
        "hi": np.where(there, np.maximum(hi[i], hi[other]), np.where(right[i], hi[i], _FAR)),
    }


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order as of ``lexsort``, and where in it the keys other than the first change."""
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for k in keys[1:]:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    return order, fresh


def _spread(order: np.ndarray, fresh: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A value of each group, for its members."""
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = values[np.cumsum(fresh) - 1]
    return out


def _documents(order: np.ndarray, fresh: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest id of each group, whose members are in order of their ids."""
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(order)) - 1 if len(order) else first
    return ids[order][first], ids[order][last]


# --- names ---------------------------------------------------------------------------------------------------


def _texts(body: blocks.Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal texts of a block, in the order of their names."""
    return _groups(body["ids"], body["digest2"], body["digest1"].view(np.uint64))


def _extract_words(body: blocks.Arrays):
    """Keys of words and of whole texts with their documents; the second half of either name stands in ``a``."""
    code = blocks.codes(body)
    ids = np.repeat(body["ids"], body["lens"])
    n = len(body["words"])
    least, most = np.full(n, blocks.NO_ID, dtype=np.int64), np.full(n, np.iinfo(np.int64).min, dtype=np.int64)
    np.minimum.at(least, code, ids)
    np.maximum.at(most, code, ids)
    order, fresh = _texts(body)
    one = order[fresh]
    least_text, most_text = _documents(order, fresh, body["ids"])
    keys = np.concatenate([body["words"], body["digest1"].view(np.uint64)[one]])
    made = {
        "a": np.concatenate([body["checks"].astype(np.int64), body["digest2"][one]]), "text": np.repeat(np.array([0, 1], np.uint8), [n, len(one)]),
        "least": np.concatenate([least, least_text]), "several": np.concatenate([most > least, most_text > least_text]),
    }
    sort = np.lexsort((made["a"], made["text"], keys))
    return keys[sort], lambda i: {c: v[sort][i] for c, v in made.items()}


def _reduce_words(shards: int):
    def reduce(keys: np.ndarray, parts: list[blocks.Arrays]):
        """Names of words that stand in several documents, 0 for others; for whole texts, the least document."""
        a, text, least, several = (np.concatenate([p[c] for p in parts]) for c in ("a", "text", "least", "several"))
        order, fresh = _groups(least, a, text, keys)
        name = _named(order, fresh, least, several, int(blocks.ranged(keys[:1], shards)[0]), shards, 0)
        least = np.where(text == 1, _spread(order, fresh, _documents(order, fresh, least)[0]), 0)
        name = np.where(text == 1, 0, name)
        return [{"name": n, "least": m, "text": t} for n, m, t in zip(blocks.apart(name, parts), blocks.apart(least, parts), blocks.apart(text, parts))], None

    return reduce


def _named(order, fresh, least, several, shard: int, shards: int, level: int) -> np.ndarray:
    """A number for each group of several documents that no other group, shard or round gives; 0 for other groups."""
    low, high = _documents(order, fresh, least)
    many = (high > low) | np.logical_or.reduceat(several[order], np.flatnonzero(fresh))
    number = np.where(many, ((np.cumsum(many) * shards + shard) << 3) + level + 1, 0).astype(np.int64)
    return _spread(order, fresh, number)


def _asked(m: blocks.Arrays, ids: np.ndarray, window: int):
    """What of a round can be named: the useful symbols, and which of them are runs or pairs, grouped."""
    useful = (m["lo"] > -_FAR // 2) & (m["hi"] < _FAR // 2) & (m["hi"] - m["lo"] <= window)
    asks = np.flatnonzero(useful & ((m["l"] > 0) | (m["k"] > 1)))
    parts = [m[c][asks] for c in PAIR]
    key = np.full(len(asks), 1, dtype=np.uint64)
    for v in parts:
        key = arrays.mixed(key * _ODD + v.astype(np.uint64))
    order, fresh = _groups(ids[m["start"][asks]], *parts, key)
    return useful, asks, key, order, fresh


def _extract_pairs(level: int, window: int):
    def extract(body: blocks.Arrays):
        s = _open(body)
        m = meet(s, level)
        ids = s["ids"][s["of"]]
        _, asks, key, order, fresh = _asked(m, ids, window)
        one = order[fresh]
        least, most = _documents(order, fresh, ids[m["start"][asks]])
        made = {c: m[c][asks][one] for c in PAIR} | {"least": least, "several": most > least}
        made["k"], made["l"] = made["k"].astype(np.uint32), made["l"].astype(np.uint32)
        return key[one], lambda i: {c: v[i] for c, v in made.items()}

    return extract


def _reduce_pairs(shards: int, level: int):
    def reduce(keys: np.ndarray, parts: list[blocks.Arrays]):
        own = [np.concatenate([p[c] for p in parts]) for c in PAIR]
        least, several = (np.concatenate([p[c] for p in parts]) for c in ("least", "several"))
        order, fresh = _groups(least, *own, keys)
        name = _named(order, fresh, least, several, int(blocks.ranged(keys[:1], shards)[0]), shards, level)
        return [{"name": x} for x in blocks.apart(name, parts)], None

    return reduce


# --- state ---------------------------------------------------------------------------------------------------


def _open(body: blocks.Arrays) -> blocks.Arrays:
    """A stored state with, for every live word, its stretch, text number and place in the text."""
    size = body["stretch_size"].astype(np.int64)
    stretch = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(stretch))
    s = body | {"stretch": stretch, "of": body["stretch_of"][stretch], "place": body["stretch_at"][stretch] + at - first[stretch]}
    if "x" not in s:
        return s | {"x": body["words"], "start": at, "end": at + 1, "lo": at, "hi": at + 1}
    lo, hi = body["start"] - body["back"].astype(np.int64), body["end"] + body["ahead"].astype(np.int64)
    return s | {"lo": np.where(body["back"] == _AWAY, -_FAR, lo), "hi": np.where(body["ahead"] == _AWAY, _FAR, hi)}


def _windows(stretch: np.ndarray, window: int) -> np.ndarray:
    """Whether a window that begins at a live word stays in its stretch."""
    out = np.zeros(len(stretch), dtype=bool)
    if len(stretch) >= window:
        out[: len(stretch) - window + 1] = stretch[window - 1 :] == stretch[: len(stretch) - window + 1]
    return out


def _close(s: blocks.Arrays, symbols: blocks.Arrays | None, barriers: tuple[np.ndarray, np.ndarray], window: int) -> tuple[int, bytes]:
    """Live windows, and the state without windows that hold the words of a barrier and without words that no window covers.

    Without ``symbols`` every word is one.
    """
    n = len(s["words"])
    out = np.zeros(n + 1, dtype=np.int64)
    a, b = np.maximum(barriers[1] - window, 0), barriers[0] + 1
    np.add.at(out, a[a < b], 1)
    np.add.at(out, b[a < b], -1)
    held = np.cumsum(out[:-1]) > 0
    live = _windows(s["stretch"], window) & ~held & ~s["dead"].astype(bool)
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(live)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    kept = np.cumsum(cover[:-1]) > 0
    # A stretch ends where kept words do not go on; windows that overlap or touch are one stretch.
    i = np.flatnonzero(kept)
    fresh = np.ones(len(i), dtype=bool)
    fresh[1:] = (i[1:] != i[:-1] + 1) | (s["stretch"][i[1:]] != s["stretch"][i[:-1]])
    new = np.cumsum(kept) - 1
    first = i[fresh]
    size = np.diff(np.append(np.flatnonzero(fresh), len(i)))
    state = {c: s[c] for c in ("ids", "none", "lens", "text_h", "copied")} | {
        "words": s["words"][i], "dead": ~live[i], "stretch_at": s["place"][first], "stretch_of": s["of"][first], "stretch_size": size,
    }
    if symbols:
        gone = np.concatenate([[0], np.cumsum(~kept)])
        whole = np.flatnonzero(gone[symbols["end"]] == gone[symbols["start"]])
        start, end, lo, hi = (symbols[c][whole] for c in ("start", "end", "lo", "hi"))
        clip = lambda d: np.where((d < 0) | (d >= _AWAY), _AWAY, d).astype(np.uint8)
        state |= {"x": symbols["x"][whole], "start": new[start], "end": new[end - 1] + 1, "back": clip(start - lo), "ahead": clip(hi - end)}
    return int(live.sum()), blocks.pack({k: np.asarray(v) for k, v in state.items()})


def _rows(block: int, made: tuple[int, bytes]) -> pd.DataFrame:
    return pd.DataFrame({"block": [block], "n": [made[0]], "body": [made[1]]})


def _begin(window: int):
    def finish(block: int, body: blocks.Arrays, rows: pd.DataFrame) -> pd.DataFrame:
        got = blocks.joined(rows) or {c: np.zeros(0, np.int64) for c in ("name", "least", "text")}
        name, least = got["name"][got["text"] == 0], got["least"][got["text"] == 1]
        lens, ids = body["lens"], body["ids"]
        copied = (_spread(*_texts(body), least) < ids) & (lens >= window) if len(ids) else np.zeros(0, bool)
        words = name[blocks.codes(body)] if len(name) else np.zeros(0, np.int64)
        at, of = np.arange(len(words)), np.repeat(np.arange(len(lens)), lens)
        s = {
            "ids": ids, "none": body["none"], "lens": lens, "text_h": body["text_h"], "copied": copied,
            "words": words, "dead": copied[of], "stretch": of, "of": of, "place": at - (np.cumsum(lens) - lens)[of],
        }
        lone = at[words == 0]
        return _rows(block, _close(s, None, (lone, lone + 1), window))

    return finish


def _advance(level: int, window: int):
    def finish(block: int, body: blocks.Arrays, rows: pd.DataFrame) -> pd.DataFrame:
        s = _open(body)
        m = meet(s, level)
        useful, asks, _, order, fresh = _asked(m, s["ids"][s["of"]], window)
        x = m["a"].copy()
        if len(asks):
            x[asks] = _spread(order, fresh, blocks.joined(rows)["name"])
        lone = useful & (x == 0)
        barriers = m["lo"][lone], m["hi"][lone]
        i = np.flatnonzero(useful & ~lone)
        symbols = {"x": x[i]} | {c: m[c][i] for c in ("start", "end", "lo", "hi")}
        return _rows(block, _close(s, symbols, barriers, window))

    return finish


# --- windows -------------------------------------------------------------------------------------------------


def _named_windows(body: blocks.Arrays, window: int):
    s = _open(body)
    at = np.flatnonzero(~s["dead"].astype(bool))
    words = s["words"].view(np.uint64)
    name, check = (arrays.window_hashes(words, window, salt)[at] for salt in (1, 2))
    order, fresh = _groups(s["ids"][s["of"][at]], check, name)
    return s, at, name, check, order, fresh


def _extract_windows(window: int):
    def extract(body: blocks.Arrays):
        # Both halves of a window's name decide; the least document of each name is kept.
        s, at, name, check, order, fresh = _named_windows(body, window)
        one = order[fresh]
        return name[one], lambda i: {"check": check[one][i], "ids": s["ids"][s["of"][at[one]]][i]}

    return extract


def _reduce_windows(keys: np.ndarray, parts: list[blocks.Arrays]):
    check, ids = (np.concatenate([p[k] for p in parts]) for k in ("check", "ids"))
    order, fresh = _groups(ids, check, keys)
    return [{"least": x} for x in blocks.apart(_spread(order, fresh, ids[order][fresh]), parts)], None


def _removals(window: int):
    def finish(block: int, body: blocks.Arrays, rows: pd.DataFrame) -> pd.DataFrame:
        s, at, _, _, order, fresh = _named_windows(body, window)
        hit = _spread(order, fresh, blocks.joined(rows)["least"]) < s["ids"][s["of"][at]] if len(at) else np.zeros(0, bool)
        of, at = s["of"][at[hit]], s["place"][at[hit]]
        # Overlapping windows of one text become one span.
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] > at[:-1] + window) | (of[1:] != of[:-1])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(at)) - 1 if len(at) else i
        whole = np.flatnonzero(s["copied"])
        doc = np.concatenate([of[i], whole]).astype(np.int64)
        sort = np.argsort(doc, kind="stable")
        lo = np.concatenate([at[i], np.zeros(len(whole), np.int64)])[sort]
        hi = np.concatenate([at[j] + window, s["lens"][whole]])[sort]
        texts, first = np.unique(doc[sort], return_index=True)
        cut = lambda v: pd.Series(np.split(v, first[1:]) if len(first) else [], dtype=object)
        return pd.DataFrame({"doc_id": s["ids"][texts], "text_hash": s["text_h"][texts], "starts": cut(lo), "ends": cut(hi)})

    return finish


STATE = "block long, n long, body binary"


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, text_hash, starts, ends)``: word spans to remove, for every text that has any.

    Rows are named by id and hash of the text.  A null id is ``blocks.NO_ID`` here.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_h"))
    corpus = blocks.build(rows, carry=("text_h",), digest=True, checked=True)
    shards = blocks.shards_for(blocks.total(corpus, "n_keys"))
    answers = blocks.exchange(corpus, _extract_words, _reduce_words(shards), shards)
    state = materialize(blocks.receive(corpus, answers, _begin(window), STATE, ("body",)))
    for level in range(1, rounds + 1):
        shards = blocks.shards_for(blocks.total(state, "n") // 2)
        answers = blocks.exchange(state, _extract_pairs(level, window), _reduce_pairs(shards, level), shards, ("body",))
        state = materialize(blocks.receive(state, answers, _advance(level, window), STATE, ("body",)))
    shards = blocks.shards_for(blocks.total(state, "n"))
    first = blocks.exchange(state, _extract_windows(window), _reduce_windows, shards, ("body",))
    return blocks.receive(state, first, _removals(window), "doc_id long, text_hash long, starts array<long>, ends array<long>", ("body",))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = (t.as_py() or "").encode().split()  # bytes split at U+0020 and U+0009..U+000D
            kept, at = [], 0
            for a, b in zip(starts or (), ends or ()):
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
        n, gone, sha, kept_text = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)`` for every row of ``docs``."""
    spans = materialize(repeated_spans(docs, text, window)).dropDuplicates(["doc_id", "text_hash"])
    # How many texts have repeats is not bounded, so the spans are never broadcast.
    spans = spans.select(F.col("doc_id").alias("_id"), "text_hash", "starts", "ends").hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    on = (F.coalesce("doc_id", F.lit(int(blocks.NO_ID))) == F.col("_id")) & (F.xxhash64("text") == F.col("text_hash"))
    joined = rows.join(spans, on, "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op5_repeat_removal(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).drop("kept_text")
