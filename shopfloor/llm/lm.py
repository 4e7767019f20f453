"""Language-model scores from a bigram trie in Elias-Fano form.

The model is a bigram model smoothed towards smoothed unigrams (a Dirichlet prior of ``MU`` tokens):

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU)

Two exchanges between blocks of the corpus make it and apply it.  In the first, words meet in shards that sum
their training counts and number them.  In the second, the distinct bigrams of each block, training or not, meet
in shards of the bigram space; a shard sums the training counts, builds a trie of its bigrams with quantised
smoothed probabilities, memory-maps its levels, and looks every block's bigrams up by successor search under
their context.  No task holds more of the model than its shard, and a word or bigram of any frequency is one
entry per block.

Rules for unusual input
-----------------------
null or empty text     only the end token
very long text         one block by itself
null doc_id            a training row, returned with its null id
ties, repeated rows    each counts and is returned by itself
no training row        N is 0 and every token unknown; scores are those of the smoothed formulas
extra columns          ignored
empty table            empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, blocks
from .elias_fano import Trie, mapped
from .scratch import materialize

MU = 100.0  # strength of the prior, in tokens; held-out texts are likeliest with about this much
STEP = 4096  # quantisation: steps per decade of probability
MISSING = 0xFFFF
END = np.uint64(0xE3779B97F4A7C15E)  # stands for the end among word hashes
END_CHECK = np.uint32(0xE3779B97)
BEGIN = (1 << 32) - 1  # the context of a text's first token
LOW = np.uint64((1 << 32) - 1)


def _word_extract(body: blocks.Arrays):
    """Sorted words with the end among them, and their training counts."""
    lens, train = body["lens"], body["train"].astype(bool)
    counts = np.bincount(blocks.codes(body), weights=np.repeat(train, lens), minlength=len(body["words"])).astype(np.int64)
    at = int(np.searchsorted(body["words"], END))
    keys, checks = np.insert(body["words"], at, END), np.insert(body["checks"], at, END_CHECK)
    counts = np.insert(counts, at, int(train.sum()))
    return keys, lambda i: {"count": counts[i], "check": checks[i]}


def _word_reduce(shards: int):
    def reduce(keys: np.ndarray, parts: list[blocks.Arrays]):
        checks = np.concatenate([p["check"] for p in parts] or [np.zeros(0, np.uint32)])
        distinct, _, where = blocks.distinct(keys, checks)
        count = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(count, where, np.concatenate([p["count"] for p in parts]))
        own = {"total": np.array([count.sum(), (count > 0).sum()])}
        # A number that no other shard gives: place in the shard, and the shard.
        shard = int(blocks.ranged(keys[:1], shards)[0])
        number = np.arange(len(distinct), dtype=np.int64) * shards + shard
        if number[-1] >= BEGIN:
            raise ValueError("more distinct words than 32-bit numbers")
        count, number, end = (blocks.apart(x, parts) for x in (count[where], number[where].astype(np.uint32), (keys == END) & (checks == END_CHECK)))
        answers = [{"count": c, "number": n, "end": e} for c, n, e in zip(count, number, end)]
        return answers, own

    return reduce


def _sums(answers: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct training tokens over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [blocks.unpack(b.as_py())["total"] for b in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in got], pa.int64()) for i in (0, 1)], ["n", "v"])

    row = answers.where("block = -1").select("body").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


class _Bigrams:
    """A block's tokens with their counts, and its distinct bigrams in order."""

    def __init__(self, body: blocks.Arrays, rows: pd.DataFrame):
        words = blocks.joined(rows)
        place, lens = blocks.codes(body), body["lens"]
        # The end stands at its sorted place among the answers: words after it move by one.
        at = int(np.flatnonzero(words["end"])[0])
        own = np.delete(np.arange(len(words["number"])), at)[place]
        sizes = lens + 1
        ends = np.cumsum(sizes) - 1
        token = np.empty(int(sizes.sum()), dtype=np.int64)
        inner = np.ones(len(token), dtype=bool)
        inner[ends] = False
        token[inner], token[ends] = own, at
        first = ends - lens
        self.sizes, self.count = sizes, words["count"][token]
        context = np.empty(len(token), dtype=np.uint64)
        context[1:] = words["number"][token[:-1]]
        self.before = np.empty(len(token), dtype=np.int64)
        self.before[1:] = self.count[:-1]
        context[first] = BEGIN
        self.before[first] = words["count"][at]  # texts begin as often as they end
        train = np.repeat(body["train"].astype(bool), sizes)
        keys = context << np.uint64(32) | words["number"][token].astype(np.uint64)
        self.keys, some, self.where = np.unique(keys, return_index=True, return_inverse=True)
        self.seen = np.bincount(self.where, weights=train, minlength=len(self.keys)).astype(np.uint32)
        self.some = some


def _base(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return (count + 0.5) / (n + 0.5 * (v + 1))


def _bigram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return blocks.ranged(arrays.mixed(keys), shards)


def _bigram_reduce(n: int, v: int, mu: float):
    def reduce(keys: np.ndarray, parts: list[blocks.Arrays]):
        # Counts of the words come with the training bigrams only.
        seen, before, count = (np.concatenate([p[k] for p in parts]) for k in ("seen", "before", "count"))
        distinct, where = np.unique(keys, return_inverse=True)
        times = np.bincount(where, weights=seen)
        known = np.flatnonzero(times)
        some = np.unique(keys[seen > 0], return_index=True)[1]
        p = (times[known] + mu * _base(count[some], n, v)) / (before[some] + mu)
        codes = np.clip(np.rint(-np.log10(p) * STEP), 0, MISSING - 1).astype(np.uint16)
        trie = Trie.build(distinct[known] >> np.uint64(32), distinct[known] & LOW, codes)
        with mapped(trie) as levels:
            model = Trie(levels)
            found = np.concatenate([model.lookup(k >> np.uint64(32), k & LOW, MISSING) for k in np.array_split(distinct, max(1, len(distinct) // 200_000))])
            del model
        return [{"code": c} for c in blocks.apart(found[where], parts)], None

    return reduce


def score(docs: DataFrame, held_out: str, text: str = "text", mu: float = MU) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Rows where the boolean column ``held_out`` is true are scored but not learnt from.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"), F.when(F.col(held_out), 0).otherwise(1).cast("long").alias("train"))
    corpus = blocks.build(rows, lower=True, carry=("train",), checked=True)
    shards = blocks.shards_for(blocks.total(corpus, "n_keys"))
    words = materialize(blocks.exchange(corpus, _word_extract, _word_reduce(shards), shards))
    n, v = _sums(words)
    shards2 = blocks.shards_for(blocks.total(corpus, "n_tokens"))

    def send(block: int, body: blocks.Arrays, answers: pd.DataFrame) -> pd.DataFrame:
        b = _Bigrams(body, answers)
        learnt = lambda i: b.some[i[b.seen[i] > 0]]
        select = lambda i: {"seen": b.seen[i], "before": b.before[learnt(i)], "count": b.count[learnt(i)]}
        return pd.DataFrame(blocks.messages(block, b.keys, _bigram_shard(b.keys, shards2), select, shards2), columns=["shard", "block", "body"])

    sent = blocks.receive(corpus, words, send, "shard int, block long, body binary", ("body",))
    bigrams = blocks.answered(sent, _bigram_reduce(n, v, mu))
    both = words.where("block >= 0").select("block", "shard", "body").unionByName(bigrams.select("block", (-1 - F.col("shard")).cast("int").alias("shard"), "body"))

    def finish(block: int, body: blocks.Arrays, answers: pd.DataFrame) -> pd.DataFrame:
        b = _Bigrams(body, answers[answers["shard"] >= 0])
        code = np.full(len(b.keys), MISSING, dtype=np.uint16)
        came = {-1 - s: raw for s, raw in zip(answers["shard"], answers["body"]) if s < 0}
        for s, i in blocks.split(_bigram_shard(b.keys, shards2), shards2):
            code[i] = blocks.unpack(came[s])["code"]
        own = code[b.where]
        base = np.log10(_base(b.count, n, v))
        log = np.where(own == MISSING, base + np.log10(mu / (b.before + mu)), own / -STEP)
        of = np.repeat(np.arange(len(b.sizes)), b.sizes)
        sums = lambda x: np.bincount(of, weights=x, minlength=len(b.sizes))
        return pd.DataFrame({
            "doc_id": blocks.ids_of(body), "held_out": body["train"] == 0, "n_tokens": b.sizes.astype(np.int64), "n_known": sums(b.count > 0).astype(np.int64),
            "train_tokens": n, "base_score": sums(base), "score": sums(log),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.receive(corpus, both, finish, schema, ("body",))


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return score(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held")), "held")
