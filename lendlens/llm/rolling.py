"""Polynomial hashes of any stretch of bytes from prefix sums, modulo 2 ** 64, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd, so that they have inverses modulo 2 ** 64.
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_LEAST = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n + n // 4, _LEAST)
        _powers[base] = tuple(
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))))
            for b in (base, pow(base, -1, 1 << 64))
        )
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """Hashes of stretches [start, end) of one array of bytes."""

    def __init__(self, flat: np.ndarray, base: int = BASES[0]):
        power, self._inverse = powers(base, len(flat) + 1)
        self._sums = np.concatenate(([np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)])))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def grams(self, width: int) -> np.ndarray:
        """Hash of the stretch of ``width`` bytes from every position that has one."""
        n = max(0, len(self._sums) - width)
        return mixed((self._sums[width : width + n] - self._sums[:n]) * self._inverse[:n])
