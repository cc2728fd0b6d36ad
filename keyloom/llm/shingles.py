"""Distinct shingles of words as 64-bit hashes, circulant MinHash signatures and parity bitmaps, in numpy.

Words are runs of bytes other than space and 9 to 13, with A-Z lower-cased. A word's hash is a polynomial over
random 64-bit values of its bytes, for all words of many texts at once from prefix sums; a shingle's hash mixes
those of its words.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 8 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def forget() -> None:
    """Drops the powers, sixteen bytes for each of the longest slice: a worker between tasks holds none."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[edges[i]:edges[i + 1]], and each text's number of words."""
    n = len(data)
    text = _LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[text]
    first = np.zeros(n + 1, bool)
    first[edges] = True
    # A text's first byte starts a word even if the byte before, of another text, is in one.
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    forth, back = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[text] * forth[:n], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MIX[0])
    return words, np.diff(np.searchsorted(starts, edges))


def shingle_sets(data: np.ndarray, edges: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of all its words where they are fewer."""
    words, counts = word_hashes(data, edges)
    ends = np.cumsum(counts)
    runs = np.zeros(len(words), np.uint64)
    if len(words) >= k:
        m = len(words) - k + 1
        for j in range(k):
            runs[:m] = (runs[:m] + words[j : j + m]) * _MIX[3]
            runs[:m] ^= runs[:m] >> np.uint64(32)
        runs[:m] = mixed(runs[:m])
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = (h + w) * _MIX[3]
                h ^= h >> np.uint64(32)
            out.append(mixed(h + _MIX[0]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Circulant:
    """Signatures of `size` coordinates out of two permutations: the first spreads hashes over the universe (an odd
    multiplier), the second is a table that is read from one place further for each coordinate."""

    def __init__(self, size: int, universe_bits: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits = universe_bits
        self.multiplier = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
        table = rng.permutation(1 << universe_bits).astype(np.uint32)
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: size - 1]]), size)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes * self.multiplier >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.rows[place[:4096]].min(axis=0)
        for i in range(4096, len(place), 4096):
            out = np.minimum(out, self.rows[place[i : i + 4096]].min(axis=0))
        return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature (rows)."""
    rows = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0], (len(signatures), 1))
    for j in range(rows.shape[2]):
        key = mixed((key + rows[:, :, j]) * _MIX[3] + np.uint64(j))
    return key.view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """Parities of the hashes' low bits, in at least eight times as many bits as hashes (a power of two, from 1024).

    The bits in which two sets' parities differ are at most the hashes in one set alone: an exact bound. Halves
    folded with XOR are the parities in half as many bits.
    """
    bits = max(1024, 1 << int(8 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def differ_least(a: bytes, b: bytes) -> int:
    """At least so many hashes are in one of the two sets alone."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
