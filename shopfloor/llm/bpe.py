"""Byte-pair encoding and decoding with a vocabulary file of the tokenizers library.

A pre-token is a list of symbols, doubly linked by places.  All adjacent pairs that have a merge go into a priority
queue by rank, then place.  The least entry is taken again and again: it is stale, and skipped, if its left symbol
is gone or the pair that stands there now has another merge; otherwise the right symbol is joined to the left one and
the two new neighbours' pairs are put in.  Decoding joins the ids' vocabulary strings as the library does that has
no decoder in the file: with one space between.

The work is one pass over the rows without a shuffle.  A worker remembers the ids of up to twice ``CACHED`` pre-tokens of up
to ``LONG`` characters, so that a frequent word is merged once; what it has forgotten it merges again.

Rules for unusual input
-----------------------
null or empty text     no ids, and an empty decoded text
very long text         one list of ids; a very long pre-token takes n log n steps
special strings        are their ids wherever they stand, as in the library
null doc_id            kept
ties, repeated rows    one result row each
extra columns          ignored unless named in ``carry``
empty table            empty result
unknown ids            decode to nothing, as in the library
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

CACHED = 150_000  # pre-tokens in each of the two generations that a worker remembers, at most
DECODED = 256  # rows that are decoded at once
LONG = 256  # characters of the longest pre-token that is remembered
PLACES = 40  # bits of a queue entry that hold the place
OLD = chr(0x0530)  # below it (Latin, Greek, Cyrillic) Python and the library agree on classes, order and lower case
WHITE = r"\x09-\x0d\x20\x85\xa0"  # Unicode's white space below it; Python's has other members


def _ranges(kind: str) -> str:
    """Characters below ``OLD`` of a general category, for a pattern's brackets."""
    of = [unicodedata.category(chr(c))[0] == kind for c in range(ord(OLD))]
    first = [c for c in range(len(of)) if of[c] and not (c and of[c - 1])]
    last = [c for c in range(len(of)) if of[c] and not of[c + 1 : c + 2] == [True]]
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(first, last))


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """What a vocabulary file says: symbols of bytes, merges, special strings, pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or told["post_processor"] or told["decoder"] or model.get("byte_fallback"):
            raise ValueError("not a vocabulary that this encoder knows")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.base = max(vocab.values()) + 1
        self.ranks: dict[int, int] = {}  # left * base + right -> rank
        self.made: list[int] = []  # rank -> id of the joined symbol
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[vocab[left] * self.base + vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.bytes = {c: b for b, c in enumerate(letters)}
        inside = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.old_pieces = re.compile(inside.replace(r"\p{L}", _ranges("L")).replace(r"\p{N}", _ranges("N")).replace(r"\s", WHITE)).findall
        self.apart = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before ``known`` was begun anew

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings; where its characters are newer, as the library cuts them."""
        if text.isascii():
            return self.old_pieces(text.lower())
        low = unicodedata.normalize("NFC", text).lower()
        if max(low) < OLD and "Σ" not in text:  # a final sigma has a rule of its own in Python
            return self.old_pieces(low)
        found = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes([self.bytes[c] for c in piece]).decode() for piece, _ in found]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        n, base, ranks = len(symbols), self.base, self.ranks
        queue = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] * base + symbols[i + 1])
            if rank is not None:
                queue.append(rank << PLACES | i)
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << PLACES) - 1
        while queue:
            entry = heappop(queue)
            i, rank = entry & place, entry >> PLACES
            j = after[i]
            if symbols[i] < 0 or j == n or ranks.get(symbols[i] * base + symbols[j]) != rank:
                continue  # stale
            symbols[i], symbols[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(symbols[i] * base + symbols[k])
                if rank is not None:
                    heappush(queue, rank << PLACES | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] * base + symbols[i])
                if rank is not None:
                    heappush(queue, rank << PLACES | h)
        return [s for s in symbols if s >= 0]

    def _ids(self, piece: str) -> bytes:
        found = self.older.get(piece) or np.array(self.merged(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self.known) >= CACHED:
                self.older, self.known = self.known, {}
            self.known[piece] = found
        return found

    def _plain(self, text: str) -> bytes:
        made = self._ids
        return b"".join([self.known.get(p) or made(p) for p in self.pieces(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.apart.split(text) if self.apart and "<" in text else [text]
        if len(parts) == 1:
            return self._plain(text)
        return b"".join([self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts)])

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist() if i in strings])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, n_tokens, ids)`` for every row; ``ids`` is binary, little-endian unsigned 32-bit integers."""
    kept = docs.select("doc_id", *carry, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for rows, _, _ in arrays.chunks(batches, "text"):
            at = rows.schema.get_field_index("text")
            ids = [v.encode(t) if t else b"" for t in rows.column(at).to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            rest = [c for i, c in enumerate(rows.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, n, pa.array(ids, pa.binary())], [*[c for c in rows.schema.names if c != "text"], "n_tokens", "ids"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text"]
    return kept.mapInArrow(run, ", ".join([*fields, "n_tokens long", "ids binary"]))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, DECODED):
                batch = whole.slice(at, DECODED)
                texts = [v.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields]
    return encoded.mapInArrow(run, ", ".join([*fields, f"`{name}` string"]))


def op11_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
