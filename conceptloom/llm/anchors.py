"""Winnowed anchors: every window of a given length gets one of its k-grams, equal windows the same one."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k-gram of ``data`` (uint8): differences of prefix sums, scaled back to position zero."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(up[: len(data)] * (data + np.uint64(1)), out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that lie one after another in ``data`` up to ``ends``: hash, first and number of the windows of each
    anchor, a maximal run of windows of ``width`` bytes in one text with the same least k-gram (the first of equals), and how far
    behind the first window's start it stands."""
    empty = np.empty(0, dtype=np.int64)
    if len(data) < width:
        return empty.view(np.uint64), empty, empty, empty
    h = gram_hashes(data, k)
    span = width - k + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if span > reach:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(at) + 1, dtype=np.int64)
    full = ends - first >= width
    np.add.at(inside, first[full], 1)
    np.add.at(inside, ends[full] - width + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    return h[at[start]], start, stop - start, at[start] - start
