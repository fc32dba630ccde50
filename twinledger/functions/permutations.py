"""Pseudorandom permutations of 0 .. n-1 that are worked out at single places."""

from __future__ import annotations

import numpy as np


def _network(n: np.ndarray, key: np.ndarray, rounds: int):
    """Halves, mask and round function of a Feistel network over the next power of four of n, for each key."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    steps = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def mixed(b, step, at):
        f = b * np.uint64(0x9E3779B97F4A7C15) + key[at] + step
        f = (f ^ (f >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
        return (f ^ (f >> np.uint64(29))) & mask[at]

    mask = (np.uint64(1) << half) - np.uint64(1)
    return half, mask, steps, mixed


def _walked(once, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Applies once() to each value until it is below its bound."""
    x = once(x, np.arange(len(x)))
    while (out := np.flatnonzero(x >= bound)).size:
        x[out] = once(x[out], out)
    return x.astype(np.int64)


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 for each key, at index: a Feistel network over the next power of four, walked until it is below n."""
    key = key.astype(np.uint64)
    half, mask, steps, mixed = _network(n, key, rounds)

    def once(x, at):
        a, b = x >> half[at], x & mask[at]
        for step in steps:
            a, b = b, a ^ mixed(b, step, at)
        return (a << half[at]) | b

    return _walked(once, index.astype(np.uint64), n.astype(np.uint64))


def unpermuted(value: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The index that `permuted` takes to a value: the same network backwards, walked the same way."""
    key = key.astype(np.uint64)
    half, mask, steps, mixed = _network(n, key, rounds)

    def once(x, at):
        a, b = x >> half[at], x & mask[at]
        for step in steps[::-1]:
            a, b = b ^ mixed(a, step, at), a
        return (a << half[at]) | b

    return _walked(once, value.astype(np.uint64), n.astype(np.uint64))
