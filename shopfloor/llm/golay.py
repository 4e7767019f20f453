"""The binary Golay code [23, 12, 7]: every 23-bit word lies within 3 bits of exactly one codeword."""

from functools import cache
from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainder(word: int) -> int:
    for i in range(N - 1, N - K - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte the syndrome part, and per syndrome the error patterns of at most 4 bits, padded with the first.

    A syndrome has one pattern of at most 3 bits; where that has 3, there are 5 more of 4 bits.
    """
    unit = [_remainder(1 << i) for i in range(N)]
    by_byte = np.zeros((3, 256), dtype=np.uint16)
    for b in range(3):
        for v in range(256):
            s = 0
            for i in range(8):
                if v >> i & 1 and b * 8 + i < N:
                    s ^= unit[b * 8 + i]
            by_byte[b, v] = s
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(N), weight):
            s = 0
            for p in places:
                s ^= unit[p]
            if weight < 4 or len(found[s]) and found[s][0].bit_count() == 3:
                found[s].append(sum(1 << p for p in places))
    errors = np.array([(x + [x[0]] * 6)[:6] for x in found], dtype=np.uint32)
    return by_byte, errors


def nearby(words: np.ndarray) -> np.ndarray:
    """For 23-bit words the 12-bit indices of all codewords within 4 bits: shape (n, 6), repeats where there are fewer.

    Two words that differ in at most 2 bits share an index: the word halfway lies within 3 bits of a codeword,
    which is within 4 bits of both.
    """
    by_byte, errors = tables()
    w = words.astype(np.uint32)
    s = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16 & 255]
    return ((w[:, None] ^ errors[s]) >> 11).astype(np.uint32)
