"""Monotone sequences in Elias-Fano form, and an n-gram trie made of them, as numpy arrays that can be memory-mapped.

A sequence of n values below u keeps the low bits of each value packed, and the high bits as unary gaps in a bit
vector with a count of ones per 64-bit word; that is about 2 + log2(u / n) bits a value.  Searches work on whole
arrays of queries.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

U64 = np.uint64


def _words(bits: np.ndarray) -> np.ndarray:
    """A bit array as 64-bit words, with one word to spare."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(U64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays for a sorted uint64 sequence of values below ``universe``."""
    n = len(values)
    width = max(0, (universe // n).bit_length() - 1) if n else 0
    low = np.concatenate([
        (((values[a : a + 65536, None] >> np.arange(width, dtype=U64)) & U64(1)).astype(np.uint8)).ravel() for a in range(0, n, 65536)
    ]) if n and width else np.zeros(0, np.uint8)
    high = (values >> U64(width)).astype(np.int64)
    bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    vector = _words(bits)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(vector), dtype=np.int64)])
    return {"low": _words(low), "high": vector, "ones": ones, "head": np.array([n, width, int(high[-1]) if n else -1], dtype=np.int64)}


class Sequence:
    """Read access to the arrays of ``encode``."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.n, self.width, self.top = (int(x) for x in parts["head"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        upper = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return (self.low[word] >> shift | upper) & U64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, of the bit vector."""
        before = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word]
        bits = self.high[word] if one else ~self.high[word]
        place = np.zeros(len(k), dtype=np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & U64((1 << step) - 1)).astype(np.int64)
            skip = rest >= count
            rest = np.where(skip, rest - count, rest)
            bits = np.where(skip, bits >> U64(step), bits)
            place += np.where(skip, step, 0)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, True) - i).astype(U64) << U64(self.width) | self._low(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """Number of values whose high part is less."""
        out = np.full(len(high), self.n, dtype=np.int64)
        out[high <= 0] = 0
        inner = (high > 0) & (high <= self.top)
        h = high[inner]
        out[inner] = self._select(h - 1, False) - (h - 1)
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x at or after ``lo`` and before ``hi``, and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> U64(self.width)).astype(np.int64)
        low = x & U64((1 << self.width) - 1)
        a, b = self._below(high), self._below(high + 1)
        a = a if lo is None else np.maximum(a, lo)
        end = b = b if hi is None else np.minimum(b, hi)
        b = np.maximum(a, b)
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < low)
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        found = (a < end) & (self._low(np.minimum(a, self.n - 1)) == low)
        return a, found


class Trie:
    """Two levels: contexts, and under each context its next tokens with a code.

    ``contexts`` and ``pointers`` (where a context's tokens start) are monotone; the tokens are made so by
    adding the context's number times the size of the token space.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        pick = lambda name: Sequence({k.partition(".")[2]: v for k, v in parts.items() if k.startswith(name + ".")})
        self.contexts, self.pointers, self.tokens = pick("contexts"), pick("pointers"), pick("tokens")
        self.codes, self.bits = parts["codes"], int(parts["bits"][0])

    @staticmethod
    def build(context: np.ndarray, token: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays for n-grams sorted by (context, token), both uint64 below 2^32."""
        n = len(context)
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if n else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        bits = int(token.max()).bit_length() if n else 1
        parts = {"codes": codes, "bits": np.array([bits])}
        for name, values, universe in (
            ("contexts", context[starts], int(context[-1]) + 1 if n else 1),
            ("pointers", np.append(starts, n).astype(U64), n + 1),
            ("tokens", number.astype(U64) << U64(bits) | token, len(starts) << bits),
        ):
            parts |= {f"{name}.{k}": v for k, v in encode(values, universe).items()}
        return parts

    def lookup(self, context: np.ndarray, token: np.ndarray, missing: int) -> np.ndarray:
        """Codes of n-grams, ``missing`` where the trie has none."""
        out = np.full(len(context), missing, dtype=self.codes.dtype)
        number, known = self.contexts.successor(context)
        known &= token >> U64(self.bits) == 0
        i = np.flatnonzero(known)
        c = number[i]
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        at, found = self.tokens.successor(c.astype(U64) << U64(self.bits) | token[i], lo, hi)
        out[i[found]] = self.codes[at[found]]
        return out


@contextmanager
def mapped(parts: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """The arrays, memory-mapped from files of the task's own temporary folder, which goes at the end."""
    with tempfile.TemporaryDirectory() as folder:
        for name, values in parts.items():
            np.save(os.path.join(folder, name), values)
        out = {name: np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r" if len(parts[name]) else None) for name in parts}
        yield out
        out.clear()
