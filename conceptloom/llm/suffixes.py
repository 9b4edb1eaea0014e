"""Two-stage suffix sorting of byte strings to a fixed depth, with numpy."""

from __future__ import annotations

import numpy as np


def words_at(data: bytes, depth: int) -> np.ndarray:
    """For each position the next eight bytes as one big-endian number; ``depth`` zero bytes follow the text."""
    padded = np.frombuffer(data + bytes(depth + 16), dtype=np.uint8)
    out = np.zeros(len(data) + depth + 8, dtype=np.uint64)
    for i in range(8):
        out |= padded[i : i + len(out)].astype(np.uint64) << np.uint64(8 * (7 - i))
    return out


def _direct(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in order of their suffixes' first ``depth`` bytes; only those still tied take part in the next eight."""
    if not len(places):
        return places
    keys = words[places]
    by = np.argsort(keys)
    places, keys = places[by], keys[by]
    start = np.append(True, keys[1:] != keys[:-1])
    tied = np.flatnonzero(~(start & np.append(start[1:], True)))
    group = np.cumsum(start)[tied]
    for at in range(8, depth, 8):
        if not len(tied):
            break
        sub = places[tied]
        keys = words[sub + at]
        by = np.lexsort((keys, group))
        places[tied] = sub[by]
        keys, group = keys[by], group[by]
        start = np.append(True, (keys[1:] != keys[:-1]) | (group[1:] != group[:-1]))
        left = ~(start & np.append(start[1:], True))
        tied, group = tied[left], np.cumsum(start)[left]
    return places


def two_stage(data: bytes, words: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of ``data``, in order up to ``depth`` bytes.

    Only suffixes smaller than their successor are sorted directly. The others are induced in one scan over the buckets
    of first bytes: a larger suffix comes right where its already placed successor tells, at the front of its bucket, and
    runs of one byte extend their own bucket wave by wave.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    text = np.frombuffer(data, dtype=np.uint8)
    nxt = np.append(text[1:], 0)
    differs = np.flatnonzero(text != nxt)
    differs = np.append(differs[differs < n - 1], n - 1)
    ahead = differs[np.searchsorted(differs, np.arange(n))]  # the end of each run of equal bytes
    smaller = (text[ahead] < nxt[ahead]) & (ahead < n - 1)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    fill = ends - counts
    low_count = np.bincount(text[smaller], minlength=256)
    order = np.empty(n, dtype=np.int64)
    direct = _direct(np.flatnonzero(smaller), words, depth)
    at = 0
    for c in np.flatnonzero(low_count):
        order[ends[c] - low_count[c] : ends[c]] = direct[at : at + low_count[c]]
        at += low_count[c]

    def induce(placed: np.ndarray, c: int) -> None:
        before = placed[placed > 0] - 1
        lead = text[before]
        before, lead = before[lead > c], lead[lead > c]
        by = np.argsort(lead, kind="stable")
        before, sizes = before[by], np.bincount(lead, minlength=256)
        done = 0
        for d in np.flatnonzero(sizes):
            order[fill[d] : fill[d] + sizes[d]] = before[done : done + sizes[d]]
            fill[d] += sizes[d]
            done += sizes[d]

    # the empty suffix is smallest of all and places the last one
    order[fill[text[n - 1]]] = n - 1
    fill[text[n - 1]] += 1
    for c in np.flatnonzero(counts):
        first = ends[c] - counts[c]
        wave = order[first : fill[c]]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            order[fill[c] : fill[c] + len(wave)] = wave
            fill[c] += len(wave)
        induce(order[first : ends[c]], int(c))
    return order


def same_prefix(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each entry of ``order`` with the one before it, up to ``depth`` (first: 0)."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(order), dtype=np.int64)
    going = np.arange(len(a))
    for at in range(0, depth, 8):
        x = words[a[going] + at] ^ words[b[going] + at]
        stop = x != 0
        if stop.any():
            out[going[stop] + 1] = at + sum((x[stop] < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
        going = going[~stop]
    out[going + 1] = depth
    return np.minimum(out, depth)
