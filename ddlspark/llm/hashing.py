"""Hashes of any stretch of bytes from running sums, and minima of neighbours."""

from __future__ import annotations

import numpy as np

#: Powers are kept for texts of this many bytes, and made anew for longer ones.
USUAL_BYTES = 1_600_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0 to n - 1.

    With sums of BYTE_VALUES times powers, (sums[b] - sums[a]) times the inverse to the a is a hash of the bytes from a to b.
    """
    if len(_powers.get("up", ())) < n:
        size = max(n, USUAL_BYTES)
        for name, base in (("up", BASE), ("down", INVERSE)):
            _powers[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base))])
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours from each position on, by doubling."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x
