"""Shingle sets and their SetSketch registers.

Register i of a set is ``max(floor(1 - log_b(x_i(d))))`` over its elements d, clipped to 0..q+1,
where the x_i(d) are exponential variates of rate a drawn by a hash of d. Taking the greatest
register merges two sketches. The registers are truncated, exponentially spaced minima: with a
base near 1 they are equal about as often as the sets are alike, which banding uses, and how often
one is the larger tells the rest, which the joint estimate uses.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

BAND_ROWS, BANDS = 6, 72
REGISTERS = BAND_ROWS * BANDS
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
SHINGLE = 5
#: Elements whose hashes are drawn at once.
BLOCK = 2048
#: Words a worker remembers.
CACHE = 500_000

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_MUL = (_rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at x20 and x09 to x0D: what bytes.lower and bytes.split do."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole text if it has fewer words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, len(words) if len(words) < k else k, np.uint64)
    for i in range(min(k, len(words))):
        out = _mixed(out * _FOLD + h[i : i + n])
    return np.unique(out)


def set_key(shingle_hashes: np.ndarray) -> bytes | None:
    """Equal for equal sets; None for the empty one."""
    return hashlib.blake2b(shingle_hashes.tobytes(), digest_size=16).digest() if len(shingle_hashes) else None


def registers(shingle_hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set, as uint16."""
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    elements = (shingle_hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, elements.shape[1], BLOCK):
        drawn = elements[:, at : at + BLOCK] * _MUL
        drawn += _ADD
        np.minimum(low, drawn.min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)



def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers; its last seven bits are the band's number."""
    rows = sketch.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        h = _mixed(h * _FOLD + rows[:, i])
    return ((h & ~np.uint64(127)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest similarity of each pair of sketches (rows of a and b) of sets of na and nb elements.

    With shares u and v of the elements of either set, a register is larger in the first with
    probability p(u - v J), in the second with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b),
    and equal otherwise. The logarithm of the likelihood is concave in J, so its greatest value is
    found by bisection of its slope.
    """
    up = (a > b).sum(axis=1).astype(float)
    down = (a < b).sum(axis=1).astype(float)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * c) / np.log(BASE)
    d = lambda x: c / (1 - np.clip(x, 1e-12, 1) * c) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        j = (low + high) / 2
        x, y = u - v * j, v - u * j
        px, py = p(x), p(y)
        slope = -v * d(x) * up / px - u * d(y) * down / py + same * (v * d(x) + u * d(y)) / np.maximum(1 - px - py, 1e-12)
        rising = slope > 0
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2
