"""Vectorised hashes of words and of runs of words, in 64-bit arithmetic that wraps."""

from __future__ import annotations

import numpy as np

#: Odd multipliers have inverses modulo 2**64, so that hashes of slices come from prefix sums.
STEP = 0x9E3779B97F4A7C15
WIDE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word, the same on every machine: eight bytes at a time, with the length."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    flat = b"".join(words) + bytes(8)
    at = np.cumsum(size) - size
    view = np.frombuffer(flat, np.uint8)
    out = size.astype(np.uint64) * np.uint64(STEP)
    left, part = size.copy(), np.arange(n)
    eight = np.lib.stride_tricks.as_strided(view, (len(flat) - 7, 8), (1, 1))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    while len(part):
        chunk = eight[at[part]].view("<u8").ravel() & masks[np.minimum(left[part], 8)]
        out[part] = mix(out[part] ^ chunk)
        at[part] += 8
        left[part] -= 8
        part = part[left[part] > 0]
    return mix(out + np.uint64(WIDE))


def powers(n: int, base: int = STEP) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(STEP) + words[j : j + n]
    return mix(out)


def range_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of words[a:b] for each a < b, dependent on the words and their order alone."""
    base = WIDE | 1
    p = powers(len(words) + 1, base)
    inverse = powers(len(words) + 1, pow(base, -1, 1 << 64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * p[:-1])])
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * np.uint64(STEP))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    k, now = 1, x
    while 2 * k <= w:
        now = np.minimum(now[:-k], now[k:])
        k *= 2
    if k < w:
        now = np.minimum(now[: len(x) - w + 1], now[w - k : w - k + len(x) - w + 1])
    return now[: len(x) - w + 1]
