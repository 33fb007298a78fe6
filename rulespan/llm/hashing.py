"""Vectorised 64-bit hashes of words and shingles inside a task (numpy over UTF-8 bytes)."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the prefix hash, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for i, base in enumerate((_STEP, _UNSTEP)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


#: A 64-bit value for each byte, A-Z as a-z, and which bytes separate words.
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_FOLDED = _LETTERS[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]
_INSIDE = np.ones(256, np.int8)
_INSIDE[[9, 10, 11, 12, 13, 32]] = 0


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every word (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of a UTF-8 text, in order."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = _INSIDE[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(a))
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_FOLDED[a] * up, out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values, in order."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = values[:m]
    for i in range(1, n):
        h = mix(h * _STEP) + values[i : m + i]
    return mix(h)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes; with fewer words the whole sequence is one."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if len(words) == 0:
        return words
    h = np.sort(runs(words, min(n, len(words))))
    if len(words) < n:  # not the same as a longer text's shingle of fewer words
        h = mix(h + np.uint64(len(words)))
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))
