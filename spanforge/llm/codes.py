"""Words and bytes as 64-bit codes, and position-free hashes of their runs."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

M64 = (1 << 64) - 1
#: Any odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BYTE_CODES = np.array([xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint64)


def words(text: str, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8; lower: A-Z become small letters. bytes.split() cuts at just this white space."""
    data = text.encode("utf-8")
    return (data.lower() if lower else data).split()


def word_codes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(1024, 1 << int(n + 1).bit_length())
        _powers[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


class Runs:
    """Hashes of runs of a sequence of codes: equal runs have equal hashes wherever they stand."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        p, self.inverse = powers(base, len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * p[: len(codes)], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(BASES[1]))

    def every(self, n: int) -> np.ndarray:
        """Of all runs of n codes."""
        k = max(0, len(self.sums) - n)
        return mix((self.sums[n:] - self.sums[:k]) * self.inverse[:k] + np.uint64(n * BASES[1] & M64)) if k else np.empty(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
