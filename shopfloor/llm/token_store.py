"""Token ids in files of separately compressed documents with one shared zstandard dictionary.

A file is: magic ``SFT1``, one byte for the width of an id (2 or 4), the 32 bytes of the dictionary's SHA-256,
the number of documents (u64), then per document its id (i64, with a null mark u8), its number of ids (u64) and the
end of its frame (u64), as four arrays, then the frames.  Any document is read with the index and one frame.  The
dictionary is trained on the serialized ids of a bounded sample.

Files are rows ``(file_no, n_docs, n_ids, content)`` of a Parquet table in the shared folder, because only Spark's
writers reach every store; ``content`` is the file.  File numbers ascend with the document ids.

Rules for unusual input
-----------------------
null or empty text     the end id alone
very long text         one frame like any other; a file holds at least one document, whatever its size
null doc_id            stored first
ties, equal doc_ids    in the order of their texts, nulls first; repeated rows are stored each
extra columns          ignored
empty table            no files
"""

from __future__ import annotations

import hashlib
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .scratch import materialize

MAGIC = b"SFT1"
FILE = 8 << 20  # bytes of ids in a file, about
PART = 64 << 20  # bytes of text that one task sorts and encodes, about
SAMPLE = 1000  # documents that the dictionary is trained on, at most
SAMPLE_CHARS = 1 << 16  # and none of them longer
DICTIONARY = 64 << 10
CACHED = 1_000_000  # pre-tokens that a worker remembers, at most
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """Class of every code point below U+0280."""
    out = np.full(0x280, OTHER, dtype=np.uint8)
    for c in range(0x280):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if chr(c) in " \t\n\r" else OTHER
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the pre-tokens of plain texts (see ``plain``): a space goes with the run of
    letters, digits or marks after it, of a longer run of white space the last character stands apart."""
    n = len(data)
    kind = _classes()[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    wide = _classes()[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    kind[lead], kind[lead + 1] = wide, wide
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    absorbed = np.zeros(n, dtype=bool)  # a plain space before, in the same text
    absorbed[1:] = (data[:-1] == 32) & ~first[1:]
    start = change & (space | ~absorbed)
    # The last white space before something else begins a pre-token.
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(offsets, starts, "right") - 1


def plain(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Texts that ``pre_tokens`` can cut: below U+0280, no apostrophe (contractions), no control character or white
    space but space, tab, LF and CR, and no special token's string."""
    odd = (data >= 0xCA) | (data == 39) | ((data < 32) & (data != 9) & (data != 10) & (data != 13)) | (data == 127)
    odd[:-1] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
    total = np.concatenate([[0], np.cumsum(odd)])
    out = total[offsets[1:]] == total[offsets[:-1]]
    raw = data.tobytes()
    for s in special:
        at = raw.find(s)
        while at >= 0:
            out[np.searchsorted(offsets, at, "right") - 1] = False
            at = raw.find(s, at + 1)
    return out


class Encoder:
    """Ids of texts by the tokenizers library; pre-tokens of plain texts are looked up, each encoded once per worker."""

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, names: list[bytes]) -> None:
        found = [e.ids for e in self.library.encode_batch_fast([x.decode() for x in names], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        base = len(self.known)
        self.known.update(zip(names, range(base, base + len(names))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.array([i for x in found for i in x], dtype=np.uint32)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """One uint32 array for each text."""
        n = len(offsets) - 1
        simple = plain(data, offsets, self.special)
        out: list = [None] * n
        other = np.flatnonzero(~simple)
        if len(other):
            raw = data.tobytes()
            for i, e in zip(other, self.library.encode_batch_fast([raw[offsets[i] : offsets[i + 1]].decode() for i in other], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype=np.uint32)
        own = np.flatnonzero(simple)
        sizes = np.diff(offsets)[own]
        if len(other):
            data = data[np.repeat(offsets[own], sizes) + arrays.ranges(sizes)]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends, of = pre_tokens(data, offsets)
        hashes, first, where = np.unique(arrays.slice_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > CACHED:
            self._forget()
        raw = data.tobytes()
        names = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        place = np.array([self.known.get(x, -1) for x in names], dtype=np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            self._learn([names[i] for i in new])
            place[new] = np.arange(len(self.known) - len(new), len(self.known))
        token = place[where]
        lens = self.sizes[token]
        ids = self.flat[np.repeat(self.starts[token], lens) + arrays.ranges(lens)]
        cuts = np.cumsum(np.bincount(of, weights=lens, minlength=len(own)).astype(np.int64))
        for i, a, b in zip(own.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist()):
            out[i] = ids[a:b]
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", sample: int = SAMPLE) -> bytes:
    """A dictionary for serialized ids, from up to ``sample`` documents of up to ``SAMPLE_CHARS`` characters, by hash of id."""
    rows = _texts(docs, text).where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for _, data, offsets in arrays.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([np.append(x, end_id).astype(f"<u{e.width}").tobytes() for x in e.encode(data, offsets)], pa.binary())], ["ids"])

    # Rows of one id are ordered by their text's hash, so that the choice is the same every time.
    picked = rows.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), F.length("text")).limit(2 * sample)
    samples = sorted(r[0] for r in picked.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[:DICTIONARY]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def file_bytes(width: int, dictionary: bytes, ids: list[int | None], sizes: list[int], frames: list[bytes]) -> bytes:
    head = MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest() + struct.pack("<Q", len(ids))
    index = [
        np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1"),
        np.array(sizes, "<u8"), np.cumsum([len(f) for f in frames], dtype="<u8"),
    ]
    return head + b"".join(x.tobytes() for x in index) + b"".join(frames)


class TokenFile:
    """Reads single documents of a file."""

    def __init__(self, content: bytes, dictionary: bytes):
        if content[:4] != MAGIC or content[5:37] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file of this dictionary")
        self.kind = f"<u{content[4]}"
        (n,) = struct.unpack("<Q", content[37:45])
        at, self.parts = 45, []
        for kind in ("<i8", "u1", "<u8", "<u8"):
            self.parts.append(np.frombuffer(content, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.content, self.at, self.n = content, at, n
        known = _dictionary(dictionary)
        self.reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()

    def doc_id(self, i: int) -> int | None:
        return None if self.parts[1][i] else int(self.parts[0][i])

    def ids(self, i: int) -> np.ndarray:
        ends = self.parts[3]
        a, b = int(ends[i - 1]) if i else 0, int(ends[i])
        return np.frombuffer(self.reader.decompress(self.content[self.at + a : self.at + b]), self.kind)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes, text: str = "text") -> DataFrame:
    """``(file_no, n_docs, n_ids, content)``, written to the shared folder; documents ascend by id over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        own = _dictionary(dictionary)
        press = zstandard.ZstdCompressor(level=3, dict_data=own) if own else zstandard.ZstdCompressor(level=3)
        ids, sizes, frames, held, seq = [], [], [], 0, 0

        def finish() -> pa.RecordBatch:
            number = TaskContext.get().partitionId() << 32 | seq
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([file_bytes(e.width, dictionary, ids, sizes, frames)], pa.binary())], ["file_no", "n_docs", "n_ids", "content"])

        for rows, data, offsets in arrays.chunks(batches, "text"):
            for doc, got in zip(rows.column(0).to_pylist(), e.encode(data, offsets)):
                body = np.append(got, end_id).astype(f"<u{e.width}").tobytes()
                ids.append(doc)
                sizes.append(len(body) // e.width)
                frames.append(press.compress(body))
                held += len(body)
            if held >= FILE:
                yield finish()
                ids, sizes, frames, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield finish()

    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    ordered = _texts(docs, text).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "file_no long, n_docs long, n_ids long, content binary"))


def read_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files; ``start`` counts all ids before it.

    Files are summed per writing task first, so what is ordered as a whole is one number per task.
    """
    sizes = files.select("file_no", "n_ids", F.shiftright("file_no", 32).alias("task"))
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n")).selectExpr("task", "sum(n) over (order by task) - n as before")
    starts = sizes.selectExpr("file_no", "task", "sum(n_ids) over (partition by task order by file_no) - n_ids as inside").join(F.broadcast(tasks), "task")
    placed = files.join(starts.select("file_no", (F.col("inside") + F.col("before")).alias("start")), "file_no").select("start", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = TokenFile(content.as_py(), dictionary)
                sizes, crcs = [], []
                for i in range(f.n):
                    ids = f.ids(i)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = start + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array([f.doc_id(i) for i in range(f.n)], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")
    dictionary = train_dictionary(docs, path, 2)
    return read_files(write_files(docs, path, 2, dictionary), dictionary)
