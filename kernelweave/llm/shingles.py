"""Sets of word shingles as sorted arrays of 64-bit hashes, and their bitmaps."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 300_000
_GOLDEN, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Words are runs of anything but ASCII white space, with A-Z in lower case."""

    def __init__(self, width: int):
        self.width = width
        self.words = WordHashes()
        with np.errstate(over="ignore"):
            self.factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the shingles; with fewer words, of all of them as one; none without words."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        with np.errstate(over="ignore"):
            rows = len(h) - k + 1
            out = np.full(rows, k, np.uint64)
            for j in range(k):
                out += h[j : j + rows] * self.factors[j]
            return np.unique(mix(out))


def set_id(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def bitmap(tokens: np.ndarray) -> bytes:
    """A power of two of at least twice as many bits (64 to 65536); a token sets the bit of its leading bits."""
    bits = min(16, max(6, int(2 * len(tokens) - 1).bit_length()))
    out = np.zeros(1 << bits, bool)
    out[tokens >> np.uint64(64 - bits)] = True
    return np.packbits(out).tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, all as long as the shortest: a bit stands for a run of bits."""
    shortest = min(map(len, bitmaps))
    rows = np.empty((len(bitmaps), shortest), np.uint8)
    for k, data in enumerate(bitmaps):
        row = np.frombuffer(data, np.uint8)
        if len(row) > shortest:
            bits = np.unpackbits(row).reshape(shortest * 8, -1).any(axis=1)
            row = np.packbits(bits)
        rows[k] = row
    return rows.view(np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    places = np.searchsorted(b, a)
    places[places == len(b)] = len(b) - 1
    return int((b[places] == a).sum())
