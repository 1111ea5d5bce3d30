"""The perfect binary Golay code (23, 12, 7): nearby codewords of 23-bit words, by array lookups."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and per remainder the error patterns of weight 4 or less, -1 filled.

    Each remainder has one pattern of weight 3 or less, put first. If that
    has weight 3 there are five more of weight 4, else none.
    """
    single = [_remainder(1 << b) for b in range(LENGTH)]
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for b in range(LENGTH):
        part, at = (low, b) if b < 12 else (high, b - 12)
        part[(np.arange(len(part)) >> at & 1) == 1] ^= single[b]
    near: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            rest = 0
            for b in bits:
                rest ^= single[b]
            near[rest].append(sum(1 << b for b in bits))
    patterns = np.full((1 << CHECK, 6), -1, np.int64)
    for rest, found in enumerate(near):
        patterns[rest, : len(found)] = found
    return low, high, patterns


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of all codewords within distance 4 of each 23-bit word, shape (n, 6), and which are there.

    Column 0 is the codeword that the word decodes to. Two words at distance
    2 or less share an index: if neither decodes to a codeword that is within
    4 of the other, they are at distance 3 or more.
    """
    low, high, patterns = tables()
    words = words.astype(np.int64)
    errors = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return (words[:, None] ^ errors) >> CHECK, errors >= 0
