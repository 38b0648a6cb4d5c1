"""Words of whole texts as arrays: boundaries and 64-bit hashes of all words of an Arrow batch at once.

A word is a run of ``[^\\x20\\x09-\\x0D]`` inside one row.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
BYTE_BASE, WINDOW_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Bytes hashed at once, and the longest word that goes that way.
STEP = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverses modulo 2**64 for i < count."""
    known = _powers.get(base)
    if known is None or len(known[0]) < count:
        size = 1 << max(16, int(count - 1).bit_length())
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        known = _powers[base] = (both[0], both[1])
    return known[0][:count], known[1][:count]


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = values ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more than rows)."""
    inside = ~_BLANK[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        last = bounds[1:][bounds[1:] > 0] - 1
        after[last] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes, finalised; words over ``STEP`` bytes by BLAKE2."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        if ends[first] - base > STEP:
            out[first] = int.from_bytes(hashlib.blake2b(data[base:ends[first]].tobytes(), digest_size=8).digest(), "little")
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(ends, base + STEP, side="right")))
        stop = int(ends[last - 1] - base)
        up, down = powers(BYTE_BASE, stop + 1)
        sums = np.zeros(stop + 1, np.uint64)
        np.cumsum((data[base:base + stop].astype(np.uint64) + np.uint64(1)) * up[:stop], out=sums[1:])
        at, to = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mixed((sums[to] - sums[at]) * down[at])
        first = last
    return out


def window_hashes(words: np.ndarray, width: int, base: int = WINDOW_BASE, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` words (of those on end; the caller drops windows over row borders)."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum((mixed(words, salt) if salt else words) * up, out=sums[1:])
    return mixed((sums[width:] - sums[:count]) * down[:count])
