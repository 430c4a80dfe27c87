"""Hashes of all byte windows of a text at once: prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def letters(seed: int) -> np.ndarray:
    """A word for each byte value."""
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n, kept for the longest text so far."""
    known = _POWERS.get(which)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        base = _MULTIPLIERS[which]
        known = tuple(np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b), U)]), dtype=U) for b in (base, pow(base, -1, 1 << 64)))
        _POWERS[which] = known
    return known[0][:n], known[1][:n]


_LETTERS = (letters(1), letters(2))


class Rolling:
    """which: 0 or 1, two independent families."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_LETTERS[which][data] * up[: len(data)], dtype=U, out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Hash of every window of this length."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of each span lo to hi, lengths included."""
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(U))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v
