"""Vectorised hashing of all stretches of a text."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (a fixed, invertible function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n + 1, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def stretch_hashes(raw: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of raw[begin:end] for each pair: sums over the letters times powers, moved to place 0."""
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return (sums[end] - sums[begin]) * down[: len(raw) + 1][begin]
