"""Vectorised hashes of words and word shingles, for use inside tasks."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value over all of them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def placed_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (run of anything but ASCII white space) of a text's bytes starts, and a 64-bit
    hash of it."""
    blank = np.concatenate(([True], _BLANK[b], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _grown(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * up[: len(b)], dtype=np.uint64)))
    return starts, mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased."""
    return placed_words(np.frombuffer(text.lower(), np.uint8))[1]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row; fewer words than k give one for the whole row, none give none."""
    k = min(k, len(words))
    if not k:
        return words
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : len(words) - k + 1 + j]
    return mixed(out + np.uint64(k))
