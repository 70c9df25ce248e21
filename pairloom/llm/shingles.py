"""Five-word shingles of a text as sets of 64-bit hashes, and min-wise signatures of such sets."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MASK = (1 << 64) - 1
#: Odd multipliers, one for each place in a shingle; the last ones mix.
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place", seed=i) | 1 for i in range(WIDTH)], dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's constants


class WordHashes(dict):
    """Word to 64-bit hash; forgets everything when it holds ``most`` words."""

    def __init__(self, most: int = 150_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside space and \\x09-\\x0D, A-Z in lower case: what bytes.split() cuts."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles, sorted.  Fewer than five words: the whole sequence as one; none: empty."""
    words = words_of(text)
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        return mix((w * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    total = w[: n - WIDTH + 1] * _PLACES[0]
    for i in range(1, WIDTH):
        total += w[i : n - WIDTH + 1 + i] * _PLACES[i]
    return np.unique(mix(total))


class MinHasher:
    """Signatures of ``bands * rows`` minima: band keys, and the minima's low ``bits`` packed in longs."""

    def __init__(self, bands: int = 32, rows: int = 4, bits: int = 4) -> None:
        self.bands, self.rows, self.bits = bands, rows, bits
        k = bands * rows
        draw = np.random.default_rng(20260101)
        self.a = (draw.integers(0, 1 << 32, k, dtype=np.uint64) | 1).astype(np.uint32)
        self.b = draw.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        self.band_a = draw.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.lanes = 64 // bits

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            out = np.minimum(out, (self.a[:, None] * x[None, at : at + 2048] + self.b[:, None]).min(axis=1))
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One key a band, from the whole minima; keys of different bands differ."""
        m = minima.reshape(self.bands, self.rows).astype(np.uint64) + np.uint64(1)
        return mix((m * self.band_a).sum(axis=1) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of each minimum, ``lanes`` of them in a long."""
        low = (minima & np.uint32((1 << self.bits) - 1)).astype(np.uint64).reshape(-1, self.lanes)
        shift = (np.arange(self.lanes) * self.bits).astype(np.uint64)
        return np.bitwise_or.reduce(low << shift[None, :], axis=1).view(np.int64)
