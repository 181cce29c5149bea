"""Symbol coding: texts as integer arrays, and fixed-width packing of symbols.

Text columns may be STRING (one symbol per code point) or BINARY (one per byte).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

# The two symbols that end the base string, the symbol that stands
# for "start of a document" in the output, and the legal single-byte symbols.
BASE_END = 1
SEPARATOR = 2
FIRST_CODE = 3  # where symbols start once ends and separators stand among them
LEGAL_LOW, LEGAL_HIGH = 3, 127


def codes_of(texts: list) -> np.ndarray:
    """All symbols of the texts, one after the other."""
    if texts and isinstance(texts[0], bytes):
        return np.frombuffer(b"".join(texts), dtype=np.uint8)
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def symbol_column(code: Column) -> Column:
    """The one-character string of a code point (any plane)."""
    any_plane = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code < 128, F.char(code)).otherwise(any_plane)


@dataclass(frozen=True)
class Alphabet:
    """The distinct symbols of a collection in ascending order."""

    codes: tuple[int, ...]

    @property
    def bits(self) -> int:
        return max(1, len(self.codes).bit_length())

    @property
    def per_long(self) -> int:
        return 63 // self.bits

    def table(self) -> np.ndarray:
        """Lookup from code point to dense code; 0 is left for the end of a text."""
        table = np.zeros(max(self.codes, default=0) + 1, dtype=np.int64)
        table[list(self.codes)] = np.arange(1, len(self.codes) + 1)
        return table


KEY_BITS = 126  # bits of text in the two longs of a key
LONGEST_WORD = 18  # bits of a rare symbol, unless there are too many symbols


@dataclass(frozen=True)
class PrefixCode:
    """Bit strings for the distinct symbols of a collection, in their order and short for frequent ones; the
    first one is for the end of a text.  No word starts another, so texts compare as their bits do."""

    codes: tuple[int, ...]
    words: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def depth(self) -> int:
        """Symbols that the bits of a key cover at least."""
        return KEY_BITS // max(self.sizes)

    def table(self) -> np.ndarray:
        """Lookup from code point to the place of its word."""
        return Alphabet(self.codes).table()


def prefix_code(counts: dict[int, int], ends: int) -> PrefixCode:
    """The code of symbols that occur ``counts`` times in texts of which there are ``ends``: a tree whose halves
    weigh about the same."""
    codes = sorted(counts)
    upto = np.cumsum([0, max(ends, 1)] + [counts[c] for c in codes])
    n = len(codes) + 1
    longest = max(LONGEST_WORD, n.bit_length() + 1)
    words, sizes = [0] * n, [1] * n
    todo = [(0, n, 0, 0)]
    while todo:
        lo, hi, word, size = todo.pop()
        if hi - lo == 1:
            words[lo], sizes[lo] = word, max(size, 1)
            continue
        room = 1 << (longest - size - 1)
        half = (upto[lo] + upto[hi]) / 2
        cut = int(np.searchsorted(upto, half))
        cut -= cut > lo + 1 and half - upto[cut - 1] < upto[cut] - half
        cut = min(max(cut, lo + 1, hi - room), hi - 1, lo + room)
        todo += [(lo, cut, word << 1, size + 1), (cut, hi, word << 1 | 1, size + 1)]
    return PrefixCode(tuple(codes), tuple(words), tuple(sizes))


def pack_words(dense: np.ndarray, at: np.ndarray, end: np.ndarray, code: PrefixCode) -> tuple[list[np.ndarray], np.ndarray]:
    """The first ``KEY_BITS`` bits of the texts that start ``at`` places of ``dense``, in two longs; what follows the
    ``end`` of a text counts as 0.  ``dense`` holds places of words, and so much of a text that goes on (its ``end`` is
    ``len(dense)``) that the bits are there.  Also returns whether the end was met."""
    sizes = np.array(code.sizes, dtype=np.int64)[dense]
    stop = np.cumsum(sizes)
    start = stop - sizes
    word = np.array(code.words, dtype=np.uint64)[dense]
    slot, free = start >> 6, 64 - (start & 63) - sizes
    over = free < 0
    own = np.where(over, word >> np.maximum(-free, 0).astype(np.uint64), word << np.maximum(free, 0).astype(np.uint64))
    bits = np.zeros((int(stop[-1]) >> 6) + 4, dtype=np.uint64)
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))  # a word starts in each slot
    bits[slot[first]] = np.bitwise_or.reduceat(own, first)
    bits[slot[over] + 1] |= word[over] << (64 + free[over]).astype(np.uint64)
    left = np.append(stop, np.iinfo(np.int64).max)[end] - start[at]
    longs = []
    for skip in (0, KEY_BITS // 2):
        place = start[at] + skip
        place = np.minimum(place, (len(bits) - 2) << 6)  # past the last end
        slot, shift = place >> 6, (place & 63).astype(np.uint64)
        long = ((bits[slot] << shift) | ((bits[slot + 1] >> np.uint64(1)) >> (np.uint64(63) - shift))) >> np.uint64(1)
        gone = (63 - np.clip(left - skip, 0, 63)).astype(np.uint64)
        longs.append(((long >> gone) << gone).astype(np.int64))
    return longs, left <= KEY_BITS


def pack_windows(dense: np.ndarray, n: int, alphabet: Alphabet, longs: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pack the ``longs * per_long`` symbols from each of the first ``n`` positions.

    A 0 ends a text: what follows it counts as 0.  Returns the packed columns and
    whether the end was met, in which case the packed value is the whole suffix.
    """
    alive = np.ones(n, dtype=np.int64)
    packed, at = [], 0
    for _ in range(longs):
        word = np.zeros(n, dtype=np.int64)
        for _ in range(alphabet.per_long):
            sym = dense[at:at + n] * alive
            alive = (sym != 0).astype(np.int64)
            word = (word << alphabet.bits) | sym
            at += 1
        packed.append(word)
    return packed, alive == 0
