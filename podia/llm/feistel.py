"""Keyed pseudorandom permutations of 0..n-1: a Feistel network with cycle-walking, on numpy arrays."""

from __future__ import annotations

import numpy as np

ROUNDS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int | np.ndarray) -> np.ndarray:
    """The places of x, all below n, under the permutation of 0..n-1 that key names.

    The network permutes the least power of four that holds n; what lands at n
    or above walks on through it until it is below n, which takes fewer than
    four steps on average. key is one number or one for each x.
    """
    if n < 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, ((int(n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    keys = np.broadcast_to(np.asarray(key, np.int64).astype(np.uint64), out.shape)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right, own = out[todo] >> half, out[todo] & mask, keys[todo]
            for i in range(ROUNDS):
                left, right = right, left ^ (_mix(right + own + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15)) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(x: int, n: int, key: int) -> int:
    """What permute() sends to x: the network run backwards, through the same cycle."""
    half = max(1, ((int(n) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    own = np.array([key], np.int64).astype(np.uint64)
    while True:
        left, right = x >> half, x & mask
        for i in reversed(range(ROUNDS)):
            with np.errstate(over="ignore"):
                mixed = int(_mix(np.array([left], np.uint64) + own + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))[0])
            left, right = right ^ (mixed & mask), left
        x = left << half | right
        if x < n:
            return x
