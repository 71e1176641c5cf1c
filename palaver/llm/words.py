"""Hashes of all words of a text at once.

A word's hash is a polynomial of its bytes' random values, taken from prefix sums over the whole
text, so no word becomes an object. Words are A-Z lower-cased and cut at x20 and x09 to x0D.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; a longer text is cut at a gap.
PIECE = 2**20

_rng = np.random.Generator(np.random.PCG64(7_919))
_BASE = int(_rng.integers(0, 2**62)) * 4 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_MIX = np.uint64(0xD6E8FEB86659FD93)

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _INVERSE))
    return _powers


def _hashed(data: np.ndarray) -> np.ndarray:
    gap = np.ones(len(data) + 2, bool)
    np.take(_GAP, data, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE.take(data) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words in order; none for a null text."""
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    if len(data) <= PIECE:
        return _hashed(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            gaps = np.flatnonzero(_GAP[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word of more bytes than a piece
                more = np.flatnonzero(_GAP[data[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(data)
        out.append(_hashed(data[at:end]))
        at = end
    return np.concatenate(out)
