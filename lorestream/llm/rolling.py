"""Hashes of substrings of a byte buffer, all at once, by prefix sums modulo 2^64."""

from __future__ import annotations

from functools import cache

import numpy as np

from lorestream.llm.common import at_rest

U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
_BASES = (GOLDEN, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers: a bijection after which every bit depends on all."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


@cache
def _bytes(which: int) -> np.ndarray:
    rng = np.random.default_rng([20260101, which])
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


#: Powers up to the longest text a task has met so far; gone when it ends.
_powers: dict[tuple[int, bool], np.ndarray] = {}
at_rest(_powers.clear)


def _power(which: int, n: int, inverse: bool) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        have = np.full(max(n, 1 << 18), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 23:
            _powers[which, inverse] = have
    return have


class Rolling:
    """Two hash families (0 and 1). Equal substrings have equal hashes wherever they lie."""

    def __init__(self, buf: np.ndarray, which: int = 0) -> None:
        n = len(buf)
        self.down = _power(which, n + 1, True)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_bytes(which)[buf] * _power(which, n + 1, False)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of every substring of k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])
