"""Karp-Rabin hashes over arrays, for bytes, words and runs of words.

A prefix sum of symbol * BASE^i (mod 2^64) gives the hash of any window as a difference
that is moved back to power 0 with the inverse of the base; a finaliser spreads it.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD_BASE = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes whose words are hashed at once.
PIECE = 1 << 20
#: Longest table of powers that a worker keeps.
KEPT_POWERS = 1 << 21

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); a worker keeps the longest table it has made, up to a bound."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) <= KEPT_POWERS:
            _tables[base] = table
    return table[:n]


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection that lets every bit depend on all others (in place)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(symbols)), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` symbols from each place on."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return spread((sums[size:] - sums[:n]) * powers(INVERSE, n))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def _pieces(data: np.ndarray, size: int):
    """Starts and ends of pieces of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data):  # on to the end of the word
            space = SPACE[data[stop:stop + size]]
            if space.any():
                stop += int(space.argmax())
                break
            stop = min(stop + size, len(data))
        yield at, stop
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has."""
    lens = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    all_hashes, all_starts = [], []
    for at, stop in _pieces(data, PIECE):  # a hash does not depend on where the word stands
        piece = data[at:stop]
        starts, ends = word_bounds(piece)
        sums = prefix_sums(piece)
        hashes = (sums[ends] - sums[starts]) * powers(INVERSE, len(piece))[starts]
        hashes += (ends - starts).astype(np.uint64)
        all_hashes.append(spread(hashes))
        all_starts.append(starts + at)
    counts = np.diff(np.searchsorted(np.concatenate(all_starts), np.append(0, np.cumsum(lens))))
    return np.concatenate(all_hashes), counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (windows may cross texts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= np.uint64(WORD_BASE)
        out += words[j:n + j]
    return spread(out)
