"""Text as numpy arrays, inside Arrow batches: bytes, words and their hashes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20  # bytes of text that are worked on at once (one longer text is worked on alone)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LONG = 256  # bytes of the longest slice that is hashed beside others


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in order, in pieces of about ``limit`` bytes: (rows, UTF-8 bytes of all texts, offsets of the texts)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            end = min(end, len(column))
            own = offsets[row : end + 1]
            yield batch.slice(row, end - row), data[own[0] : own[-1]], own - own[0]
            row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a word never crosses from one text into the next."""
    letter = np.zeros(len(data) + 2, dtype=bool)
    letter[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    first = letter[1:-1] & ~letter[:-2]
    last = letter[1:-1] & ~letter[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = letter[1:-1][cuts]
    last[cuts - 1] = letter[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def new_key() -> int:
    """A secret number for ``slice_hashes``, chosen by the driver for one run: nobody can prepare words that collide."""
    return int.from_bytes(os.urandom(8), "little")


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte slices: eight bytes after eight are mixed in, slices above ``LONG`` bytes go to XXH3.

    One step is a bijection of the state for given bytes and of the bytes for a given state, so slices of up to eight
    bytes and equal length never collide.  Longer ones do so by chance, and by design where the key is known: what decides
    by hashes alone takes two of them, with keys from ``new_key``; all others compare the bytes.
    """
    sizes = ends - starts
    step = np.uint64(int(_BASE) + 2 * key & 0xFFFFFFFFFFFFFFFF)
    key = np.uint64(key)
    out = mixed(sizes.astype(np.uint64) + _BASE ^ key)
    if not len(sizes):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    short = sizes <= LONG
    if not short.all():
        raw = data.tobytes()
        i = np.flatnonzero(~short)
        out[i] = np.array([xxhash.xxh3_64_intdigest(raw[a:b], int(key)) for a, b in zip(starts[i].tolist(), ends[i].tolist())], dtype=np.uint64)
    left = np.flatnonzero(short & (sizes > 0))
    at = 0
    while len(left):
        size = np.minimum(sizes[left] - at, 8).astype(np.uint64)
        lane = lanes[starts[left] + at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size))
        out[left] = mixed((out[left] ^ lane) + step)
        at += 8
        left = left[sizes[left] > at]
    return out


def window_hashes(values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all ``length`` consecutive values of a uint64 array, by the place of the first.

    Windows of a power of two are made of two halves; any other is made of such windows, larger ones first.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    level = mixed(values + np.uint64(salt))
    out, at, size = np.full(n, length + salt, dtype=np.uint64), length, 1
    while True:
        if length & size:  # the parts of smaller powers stand at the end
            at -= size
            out = mixed(out * _ODD + level[at : at + n])
        size *= 2
        if size > length:
            return out
        level = mixed(level[: len(level) - size // 2] * _ODD + level[size // 2 :] + np.uint64(size))


def row_digests(values: np.ndarray, sizes: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of 128-bit XXH3 digests of consecutive rows of a uint64 array, or of it and ``more`` in turn."""
    if more is not None:
        values, sizes = np.stack([values, more.astype(np.uint64)], axis=1).ravel(), 2 * sizes
    ends = np.cumsum(sizes)
    raw = np.ascontiguousarray(values).view(np.uint8)
    found = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist()))
    both = np.frombuffer(found, dtype=np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words joined by one space each: bytes, starts, ends."""
    sizes = ends - starts
    new = np.zeros(len(starts), dtype=np.int64)
    if len(starts):
        new[1:] = np.cumsum(sizes[:-1] + 1)
    out = np.full(int(sizes.sum()) + max(len(starts) - 1, 0), 32, dtype=np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(new, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
    return out.tobytes(), new, new + sizes


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, concatenated."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - counts, counts)
