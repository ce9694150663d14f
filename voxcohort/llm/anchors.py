"""Anchors of fixed-length byte strings: every string of LENGTH bytes names one position within it, by content alone.

The anchor of a string is its leftmost GRAM bytes with the smallest hash. Strings next to each other mostly share their
anchor, so a text falls into few runs of starts; equal strings have equal anchors wherever they stand.
"""

from __future__ import annotations

import numpy as np

LENGTH, GRAM = 400, 160
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = np.uint64((1 << 28) - 1)
#: Bytes worked on at once; powers of the base are kept for so many.
SPAN = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers:
        _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SPAN + LENGTH, base, dtype=np.uint64)]), dtype=np.uint64)
    return _powers[base][:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of the `size` bytes at each position."""
    x = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), dtype=np.uint64)])
    h = (x[size:] - x[:-size]) * _power(_INVERSE, len(data) - size + 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i : i + width] for each i (van Herk)."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = gram_hashes(data, gram)
    keys = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
    at = (window_minima(keys, length - gram + 1) & _MASK).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return hashes[at[first]], first, np.concatenate([first[1:], [len(at)]])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one anchor: hash of the anchor, first start, end (excluded)."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    out = []
    for a in range(0, len(data) - length + 1, SPAN):
        h, p, q = _runs_of(data[a : a + SPAN + length - 1], length, gram)
        out.append((h, p + a, q + a))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
