"""Token counts without ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the characters after it, up to the next space or line feed; a run of line
feeds is one too.  No piece of the model has a space after another character, or a line feed beside another
character, so no piece crosses a pre-token's edge and the counts add up.

Rules for unusual input
-----------------------
null or empty text     no tokens
very long text         one block by itself
null doc_id            counted and returned with its null id
ties, repeated rows    one result row each
extra columns          ignored
empty table            empty result
U+2581                 the model reads it as a space, and so does the cut
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .arrays import new_key, ranges, slice_hashes

MARK = "▁"


@cache
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or ("\n" in piece and len(piece) > 1):
            raise ValueError(f"piece {piece!r} crosses the edge of a pre-token")
    return model


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of texts, as start, end and text number."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, feed = data == 32, data == 10
    before = np.concatenate([[False], space[:-1]])
    fed = np.concatenate([[False], feed[:-1]])
    first = (space & ~before) | (feed & ~fed) | (~feed & fed)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _counts(path: str, pieces: list[bytes]) -> np.ndarray:
    """Pieces of each pre-token.  The model puts a space before a text: a leading space stands for it, otherwise
    a line feed is put in front, whose two pieces are taken off again."""
    texts = [p.decode() for p in pieces]
    led = [t[:1] == " " for t in texts]
    found = _model(path).encode([t[1:] if s else "\n" + t for t, s in zip(texts, led)], num_threads=1)
    # An empty text has no piece, a lone space has one.
    return np.array([(len(f) if len(t) > 1 else 1) if s else len(f) - 2 for f, s, t in zip(found, led, texts)], dtype=np.int32)


def _names(chars: np.ndarray, sizes: np.ndarray, key: int) -> np.ndarray:
    ends = np.cumsum(sizes, dtype=np.int64)
    return slice_hashes(chars, ends - sizes, ends, key)


def _unequal(chars: np.ndarray, sizes: np.ndarray, starts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Pre-tokens whose bytes are not those of the pre-token ``other``."""
    out = sizes != sizes[other]
    i = np.flatnonzero(~out & (other != np.arange(len(other))))
    inside = ranges(sizes[i].astype(np.int64))
    same = chars[np.repeat(starts[i], sizes[i]) + inside] == chars[np.repeat(starts[other[i]], sizes[i]) + inside]
    owner = np.repeat(i, sizes[i])
    out[owner[~same]] = True
    return np.flatnonzero(out)


def token_counts(docs: DataFrame, model: str, text: str = "text", carry: tuple[str, ...] = (), extra=((), lambda data, offsets: {})) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, ...)`` for every row; ``model`` is the path of a sentencepiece model.

    The long columns of ``carry`` come along, and those that ``extra`` makes of each text (see ``blocks.build``).

    Distinct pre-tokens of each block meet in shards, are counted there once, and their counts come back to
    the block's pre-token frequencies per document.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = blocks.unpack(row["dict"])
                sizes = known["sizes"].astype(np.int64)
                starts = np.cumsum(sizes) - sizes

                def select(i: np.ndarray) -> blocks.Arrays:
                    return {"sizes": sizes[i].astype(np.uint32), "chars": known["chars"][np.repeat(starts[i], sizes[i]) + ranges(sizes[i])]}  # noqa: B023

                out = blocks.messages(row["block"], None, blocks.ranged(_names(known["chars"], sizes, key), shards), select, shards)
                if out:
                    s, b, body = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.int64()), pa.array(body, pa.binary())], ["shard", "block", "body"])

    def reduce(keys: np.ndarray, parts: list[blocks.Arrays]):
        chars, sizes = (np.concatenate([p[k] for p in parts]) for k in ("chars", "sizes"))
        ends = np.cumsum(sizes, dtype=np.int64)
        _, first, where = np.unique(_names(chars, sizes, key), return_index=True, return_inverse=True)
        raw = chars.tobytes()
        odd = _unequal(chars, sizes, ends - sizes, first[where])
        if len(odd):  # other bytes than the first of the same hash
            own: dict[bytes, int] = {}
            for i in odd.tolist():
                name = raw[ends[i] - sizes[i] : ends[i]]
                if name not in own:
                    own[name] = len(first)
                    first = np.append(first, i)
                where[i] = own[name]
        count = np.zeros(len(first), dtype=np.uint32)
        for a in range(0, len(first), 20_000):
            i = first[a : a + 20_000]
            count[a : a + 20_000] = _counts(model, [raw[x:y] for x, y in zip((ends[i] - sizes[i]).tolist(), ends[i].tolist())])
        return [{"n": c} for c in np.split(count[where], np.cumsum([len(p["sizes"]) for p in parts])[:-1])], None

    def finish(block: int, body: blocks.Arrays, rows: pd.DataFrame) -> pd.DataFrame:
        of, place, times = blocks.bags(body)
        n = np.bincount(of, weights=blocks.joined(rows)["n"][place].astype(np.int64) * times if len(of) else None, minlength=len(body["ids"]))
        return pd.DataFrame({"doc_id": blocks.ids_of(body), "n_bytes": body["given"], "n_tokens": n.astype(np.int64)} | {c: body[c] for c in more})

    # The model reads the mark as a space; one space in front stands for the one that it adds to a text.
    given = F.coalesce(F.col(text), F.lit(""))
    more = (*carry, *extra[0])
    ready = docs.select("doc_id", *carry, F.octet_length(given).cast("long").alias("given"), F.when(given == "", "").otherwise(F.concat(F.lit(" "), F.replace(given, F.lit(MARK), F.lit(" ")))).alias("text"))
    key = new_key()
    corpus = blocks.build(ready, cut=cut, bag=True, key=key, carry=("given", *carry), extra=extra)
    shards = blocks.shards_for(blocks.total(corpus, "n_keys"))
    sent = corpus.select("block", "dict").mapInArrow(send, "shard int, block long, body binary")
    answers = blocks.answered(sent, reduce)
    schema = ", ".join(["doc_id long", "n_bytes long", "n_tokens long", *[f"{c} long" for c in more]])
    return blocks.receive(corpus, answers, finish, schema, ("body",))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
