"""SentencePiece BPE encoding that keeps offsets, and decoding.

The model file is read as it is.  A text is normalised by the longest prefix found in
the model's compiled character map, and every normalised byte remembers the bytes of
the text it came from; the pieces found in the normalised text are projected through
that alignment to byte spans of the original.

No piece has the word mark after another character, so merges never cross the start of
a run of word marks: texts are cut there into units, which are encoded by themselves and
remembered in a cache of two generations whose size is a parameter.  The rows of a batch
stand side by side in arrays: their units are named by a dictionary, and those that the
cache lacks are merged in lockstep, one merge of each at a time.

Row-wise and without exchange: an executor holds the model, its cache and a few rows.

Defined cases: a null or empty text has no pieces and decodes to the empty text;
characters outside the vocabulary become byte pieces; a repeated row is encoded again;
further columns pass through, those named as an added column give way.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from .arrow import add_columns

MARK = "▁"
#: Units in a generation of a Python worker's cache.
CACHED_UNITS = 300_000
NEVER = float("-inf")
#: Units longer than this are merged with a heap and not cached.
LONG_UNIT = 48
#: Units of about one length that are merged in lockstep.
LOCKSTEP = 2048
# Fixed values of the model file's format: piece types and the BPE model type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at, end = 0, len(data)

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class CharMap:
    """The compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size:]

    @staticmethod
    def _child_base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts at ``at``."""
        units, found = self.units, None
        node = self._child_base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            unit = units[node]
            node ^= self._child_base(unit)
            if unit & 0x100:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, start = found
        return size, self.texts[start:self.texts.index(b"\0", start)]


class Aligned(NamedTuple):
    """Normalised texts one after the other: their bytes, where each text stops, and the step that each byte comes from;
    of each step the start and end of its source bytes in its text."""

    normal: bytes
    stops: np.ndarray
    of: np.ndarray
    first: np.ndarray
    after: np.ndarray


@dataclass
class Normalizer:
    charmap: CharMap | None = None
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def _steps(self, data: bytes):
        """(replacement, start, end) along the text."""
        at = 0
        while at < len(data):
            hit = self.charmap.longest(data, at) if self.charmap else None
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at:at + size]
            yield hit[1], at, at + hit[0]
            at += hit[0]

    def align(self, text: str) -> tuple[bytes, list[int], list[int]]:
        """The normalised bytes, and of each the start and end of its source bytes."""
        normal, starts, ends = self.align_arrays(text)
        return normal, starts.tolist(), ends.tolist()

    def align_arrays(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """As ``align``, as arrays."""
        own = self.align_texts([text])
        return own.normal, own.first[own.of], own.after[own.of]

    def align_texts(self, texts: list[str]) -> "Aligned":
        """The texts one after the other.  Without a map each step is one character: they are aligned all at once."""
        data = [text.encode() for text in texts]
        if self.charmap is None and not self.squeeze:
            return self._align_characters(data)
        steps = [self._align_steps(d) for d in data]
        first, after = (np.array(list(chain.from_iterable(s[k] for s in steps)), np.int64) for k in (1, 2))
        return Aligned(b"".join([s[0] for s in steps]), np.cumsum([len(s[0]) for s in steps], dtype=np.int64),
                       np.arange(len(first)), first, after)

    def _align_characters(self, data: list[bytes]) -> "Aligned":
        mark = MARK.encode() if self.escape else b" "
        lead = mark if self.dummy_prefix else b""
        raw, lens = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data], np.int64)
        begin = np.cumsum(lens) - lens
        first = np.flatnonzero((raw & 0xC0) != 0x80)
        after = np.append(first[1:], len(raw)) if len(first) else first
        sizes = np.where(raw[first] == 0x20, len(mark), after - first)
        text = np.repeat(begin, np.diff(np.searchsorted(first, np.append(begin, len(raw)))))  # of each character
        first, after = first - text, after - text
        if lead:  # a character that has no source bytes
            at = np.flatnonzero(first == 0)
            first, after, sizes = np.insert(first, at, 0), np.insert(after, at, 0), np.insert(sizes, at, len(lead))
        normal = [lead + d.replace(b" ", mark) if d else b"" for d in data]
        return Aligned(b"".join(normal), np.cumsum([len(n) for n in normal], dtype=np.int64),
                       np.repeat(np.arange(len(first), dtype=np.int32), sizes), first, after)

    def _align_steps(self, data: bytes) -> tuple[bytes, list[int], list[int]]:
        out, starts, ends = bytearray(), [], []
        mark = MARK.encode() if self.escape else b" "

        def put(piece: bytes, start: int, end: int):
            out.extend(piece)
            starts.extend([start] * len(piece))
            ends.extend([end] * len(piece))

        after_space = self.squeeze
        for piece, start, end in self._steps(data):
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                if not out and self.dummy_prefix:
                    put(mark, start, start)
                for i in range(len(piece)):
                    put(mark if piece[i] == 0x20 else piece[i:i + 1], start, end)
                after_space = self.squeeze and piece.endswith(b" ")
        while self.squeeze and out.endswith(mark):
            del out[-len(mark):], starts[-len(mark):], ends[-len(mark):]
        return bytes(out), starts, ends


@dataclass
class PieceModel:
    """A BPE model with byte fallback."""

    pieces: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    bytes_ids: list[int]
    normalizer: Normalizer
    surface: list[str | int] = field(default_factory=list)
    #: Bytes of each piece in a normalised text.
    sizes: np.ndarray | None = None

    def __post_init__(self):
        self.sizes = np.array([1 if isinstance(s, int) else len(p.encode()) for p, s in zip(self.pieces, self.surface)], np.int64)

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        with open(path, "rb") as file:
            return cls.parse(file.read())

    @classmethod
    def parse(cls, data: bytes) -> "PieceModel":
        pieces, scores, ids, surface, bytes_ids = [], {}, {}, [], [0] * 256
        normalizer = Normalizer()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                text, kind = own[1].decode(), own.get(3, NORMAL)
                if kind in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces are not supported")
                if kind == NORMAL:
                    scores[text], ids[text] = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], len(pieces)
                    surface.append(text.replace(MARK, " "))
                elif kind == BYTE:
                    bytes_ids[int(text[3:5], 16)] = len(pieces)
                    surface.append(int(text[3:5], 16))
                else:
                    surface.append(" ⁇ " if kind == UNKNOWN else "")
                pieces.append(text)
            elif number == 2:
                own = dict(_fields(value))
                if own.get(3, 1) != BPE or not own.get(35, 0) or own.get(24, 0):
                    raise ValueError("only BPE models with byte fallback and leading word marks are supported")
            elif number == 3:
                own = dict(_fields(value))
                normalizer = Normalizer(CharMap(own[2]) if own.get(2) else None, bool(own.get(3, 1)),
                                        bool(own.get(4, 1)), bool(own.get(5, 1)))
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece has a word mark inside")
        return cls(pieces, scores, ids, bytes_ids, normalizer, surface)

    # --- encoding ---

    def merge(self, unit: str) -> list[str]:
        """The pieces of a unit: the best-scored pair is merged first, of equal ones the leftmost."""
        score, parts = self.scores.get, list(unit)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)

        def offer(i: int):
            j = after[i]
            if j < n and (s := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, len(parts[i]) + len(parts[j])))

        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been merged since
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def unit_ids(self, unit: str) -> list[int]:
        out = []
        for part in self.merge(unit):
            own = self.ids.get(part)
            if own is None:
                out.extend(self.bytes_ids[b] for b in part.encode())
            else:
                out.append(own)
        return out

    def units(self, text: str) -> list[str]:
        """The units of a text's normalised form."""
        return self.units_of(self.normalizer.align_arrays(text)[0])

    @staticmethod
    def units_of(normal: bytes) -> list[str]:
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", normal.decode())

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Begin and end of each piece in the bytes of the text."""
        begins, ends = self.project(ids, self.normalizer.align_texts([text]))
        return begins.tolist(), ends.tolist()

    def project(self, ids: list[int], aligned: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the source bytes of its text, through the alignment of the normalised ones."""
        sizes = self.sizes[np.asarray(ids, np.int64)]
        stops = np.cumsum(sizes)
        if (stops[-1] if len(stops) else 0) != len(aligned.normal):
            raise ValueError("the pieces do not cover the normalised text")
        return aligned.first[aligned.of[stops - sizes]], aligned.after[aligned.of[stops - 1]]

    # --- decoding ---

    def join(self, ids) -> str:
        """The text of pieces; bytes that are no UTF-8 become U+FFFD."""
        try:
            return "".join([self.surface[i] for i in ids])
        except TypeError:  # some are bytes
            pass
        out, run = [], bytearray()
        for i in ids:
            piece = self.surface[i]
            if isinstance(piece, int):
                run.append(piece)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids) -> str:
        text = self.join(ids)
        return text[1:] if self.normalizer.dummy_prefix and text.startswith(" ") else text


class Merges:
    """All merges of a model as a table of symbol pairs, for many short units at once.
    Symbols are the pieces, by id, and after them the characters that are no pieces."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.symbols = dict(model.ids)
        self.spelled: list[list[int]] = []  # byte ids of the characters that are no pieces
        self.of_code = np.full(sys.maxunicode + 1, -1, np.int32)  # the symbols of the characters seen so far
        for piece in model.ids:
            for c in piece:
                self.symbol(c)
        pairs = sorted((left << 32 | right, own) for piece, own in model.ids.items() for k in range(1, len(piece))
                       if (left := self.symbols.get(piece[:k])) is not None
                       and (right := self.symbols.get(piece[k:])) is not None)
        self.pairs = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.merged = np.array([m for _, m in pairs] or [-1], np.int32)
        self.scores = np.array([*(model.scores.get(p, NEVER) for p in model.pieces), NEVER], np.float32)  # -1: no merge

    def symbol(self, c: str) -> int:
        own = self.symbols.get(c)
        if own is None:
            own = self.symbols[c] = len(self.model.pieces) + len(self.spelled)
            self.spelled.append([self.model.bytes_ids[b] for b in c.encode()])
        self.of_code[ord(c)] = own
        return own

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        pair = left.astype(np.int64)
        pair <<= 32
        pair |= right  # nothing is at -1
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], -1)

    def ids(self, units: list[str]) -> list[list[int]]:
        """The ids of the pieces of each unit."""
        ids, counts = self.rows(units)
        return [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])] if units else []

    def rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of all units, one unit after the other, and how many each has."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbols = self.of_code[codes]
        if (symbols < 0).any():
            for c in np.unique(codes[symbols < 0]).tolist():
                self.symbol(chr(c))
            symbols = self.of_code[codes]
        begin, order = np.cumsum(lens) - lens, np.argsort(lens, kind="stable")
        found, counts = [np.zeros(0, np.int32)], np.zeros(len(units), np.int64)
        for a in range(0, len(order), LOCKSTEP):
            own = order[a:a + LOCKSTEP]
            merged, counts[own] = self._lockstep(symbols, begin[own], lens[own])
            found.append(merged)
        sorted_counts = counts[order]
        place = np.empty(len(units), np.int64)
        place[order] = np.cumsum(sorted_counts) - sorted_counts
        return self._spell(_gather(np.concatenate(found), place, counts), counts)

    def _spell(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the byte pieces of characters that are no pieces."""
        n = len(self.model.pieces)
        odd = np.flatnonzero(symbols >= n)
        if not len(odd):
            return symbols, counts
        spelled = [self.spelled[s - n] for s in symbols[odd].tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = [len(ids) for ids in spelled]
        out = np.repeat(symbols, sizes)
        out[np.repeat(symbols >= n, sizes)] = list(chain.from_iterable(spelled))
        stops = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return out, np.diff(stops)

    def _lockstep(self, symbols: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge units, one merge of each at a time, and return their symbols and how many each has.  A unit is a row of linked
        symbols between two guards of -1, as are the places behind its end and those that a merge leaves."""
        n, width = len(lens), int(lens.max()) + 2
        own = np.full((n, width), -1, np.int32)
        row = np.repeat(np.arange(n), lens)
        step = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        own[row, step + 1] = symbols[np.repeat(begin, lens) + step]
        merge = np.full_like(own, -1)
        merge[:, :-1] = self._merge_of(own[:, :-1], own[:, 1:])
        score = self.scores[merge]
        own, merge, flat = own.ravel(), merge.ravel(), score.ravel()
        after = np.arange(1, len(own) + 1)
        before = after - 2
        alive = np.arange(n)
        while True:
            here = alive * width + score[alive].argmax(axis=1)  # of equal ones the leftmost
            go = flat[here] > NEVER
            alive, here = alive[go], here[go]
            if not len(alive):
                break
            gone = after[here]
            own[here], own[gone], flat[gone] = merge[here], -1, NEVER
            right = after[here] = after[gone]
            before[right] = here
            pair = np.concatenate([before[here], here])
            merge[pair] = made = self._merge_of(own[pair], own[np.concatenate([here, right])])
            flat[pair] = self.scores[made]
        kept = own >= 0
        return own[kept], kept.reshape(n, width).sum(axis=1)


def _gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` values from each of the ``starts`` on, one run after the other."""
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]


class Rows:
    """Growing rows of numbers."""

    def __init__(self):
        self.values, self.stops, self.n = np.zeros(1024, np.int32), np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        at = int(self.stops[self.n])
        self.values = self._with_room(self.values, at + len(values))
        self.stops = self._with_room(self.stops, self.n + 1 + len(counts))
        self.values[at:at + len(values)] = values
        self.stops[self.n + 1:self.n + 1 + len(counts)] = at + np.cumsum(counts)
        self.n += len(counts)

    @staticmethod
    def _with_room(values: np.ndarray, size: int) -> np.ndarray:
        if size <= len(values):
            return values
        out = np.zeros(max(size, len(values) + len(values) // 2), values.dtype)
        out[:len(values)] = values
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.stops[rows]
        counts = self.stops[rows + 1] - starts
        return _gather(self.values, starts, counts), counts


class UnitCache(dict):
    """unit -> its row in a table of ids, in two generations."""

    def __init__(self, model: PieceModel, size: int):
        super().__init__()
        self.model, self.size, self.merges = model, max(size, 1), Merges(model)
        self.table, self.old, self.old_table = Rows(), {}, Rows()
        self.decimal = pa.array([str(i) for i in range(len(model.pieces))])
        self.surface = pa.array([bytes([s]) if isinstance(s, int) else s.encode() for s in model.surface], pa.binary())

    def _keep(self, units: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        stops, at = np.append(0, np.cumsum(counts)), 0
        while at < len(units):
            if len(self) >= self.size:
                self.old, self.old_table, self.table = dict(self), self.table, Rows()
                self.clear()
            stop = min(len(units), at + self.size - len(self))
            self.update(zip(units[at:stop], range(self.table.n, self.table.n + stop - at)))
            self.table.add(ids[stops[at]:stops[stop]], counts[at:stop])
            at = stop

    def rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different units, one unit after the other, and how many each has; those that are in neither generation
        are encoded all at once."""
        place = np.fromiter(map(self.get, units, repeat(-1)), np.int64, len(units))
        known, absent = np.flatnonzero(place >= 0), np.flatnonzero(place < 0).tolist()
        parts = [(known, *self.table.take(place[known]))]
        place = np.fromiter((self.old.get(units[i], -1) for i in absent), np.int64, len(absent))
        back = [i for i, p in zip(absent, place.tolist()) if p >= 0]
        parts.append((np.array(back, np.int64), *self.old_table.take(place[place >= 0])))
        new = [i for i, p in zip(absent, place.tolist()) if p < 0]
        short = [i for i in new if len(units[i]) <= LONG_UNIT]
        parts.append((np.array(short, np.int64), *self.merges.rows([units[i] for i in short])))
        for own, (_, ids, counts) in ((back, parts[1]), (short, parts[2])):
            self._keep([units[i] for i in own], ids, counts)
        for i in new:
            if len(units[i]) > LONG_UNIT:
                ids = np.array(self.model.unit_ids(units[i]), np.int32)
                parts.append((np.array([i]), ids, np.array([len(ids)])))
        which, ids, counts = (np.concatenate(x) for x in zip(*parts))
        out = np.empty(len(units), np.int64)
        out[which] = np.arange(len(which))
        return _gather(ids, (np.cumsum(counts) - counts)[out], counts[out]), counts[out]

    def take(self, units) -> dict:
        """unit -> (ids as 32-bit numbers, ids as text, decoded text)"""
        units = list(dict.fromkeys(units))
        ids, counts = self.rows(units)
        stops = np.append(0, np.cumsum(counts))
        return {u: (own.tobytes(), text, decoded) for u, own, text, decoded in zip(
            units, np.split(ids, stops[1:-1]), self.texts(ids, stops).to_pylist(), self.joined(ids, stops).to_pylist())}

    def texts(self, ids: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The decimal ids of each run, joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), self.decimal.take(pa.array(ids))), ",")

    def joined(self, ids: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The text of the pieces of each run."""
        raw = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), self.surface.take(pa.array(ids)))
        try:
            return pc.binary_join(raw, pa.scalar(b"", pa.binary())).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.model.join(ids[a:b].tolist()) for a, b in zip(stops[:-1], stops[1:])], pa.string())

    def decoded(self, ids: np.ndarray, stops: np.ndarray) -> pa.Array:
        text = self.joined(ids, stops)
        if not self.model.normalizer.dummy_prefix:
            return text
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)

    def encode(self, aligned: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts, one text after the other, and from where to where each text has them."""
        starts = unit_starts(aligned.normal, aligned.stops)
        offsets = np.append(starts, len(aligned.normal))
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(aligned.normal)).dictionary_encode()
        ids, counts = self.rows(units.dictionary.to_pylist())
        which = units.indices.to_numpy()
        ids, counts = _gather(ids, (np.cumsum(counts) - counts)[which], counts[which]), counts[which]
        return ids, np.append(0, np.cumsum(counts))[np.append(0, np.searchsorted(starts, aligned.stops))]


def unit_starts(normal: bytes, stops: np.ndarray) -> np.ndarray:
    """Where the units of normalised texts begin: at each text and each run of word marks."""
    data, mark = np.frombuffer(normal, np.uint8), MARK.encode()
    here = np.ones(max(len(data) - len(mark) + 1, 0), bool)
    for k, byte in enumerate(mark):
        here &= data[k:k + len(here)] == byte
    marks = np.flatnonzero(here)
    first = np.zeros(len(data) + 1, bool)
    first[marks[np.diff(marks, prepend=-len(mark) - 1) != len(mark)]] = True
    first[np.append(0, stops)] = True
    return np.flatnonzero(first[:-1])


@lru_cache(maxsize=1)
def cache_of(model_path: str, cached_units: int) -> UnitCache:
    """The model and its cache, which outlive a task in its Python worker."""
    return UnitCache(PieceModel.load(model_path), cached_units)


SCHEMA = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("ids_text", T.StringType()), T.StructField("begins", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("spans_sha256", T.StringType()),
    T.StructField("decoded", T.StringType())])
SPANS = {"begins", "ends", "spans_sha256"}


def _sha256(*values: np.ndarray) -> str:
    digest = sha256()
    for v in values:
        digest.update(v.astype("<i8", copy=False))
    return digest.hexdigest()


def sentencepiece(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"),
                  cached_units: int = CACHED_UNITS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, if given) with ``outputs``, out of: ``n_tokens``; ``ids``; ``ids_text`` (decimal ids joined
    by commas); ``begins`` and ``ends`` (byte spans of the pieces in the text); ``spans_sha256`` (of all begins, then all ends, as
    little-endian 64-bit numbers); ``decoded``."""
    schema = T.StructType([SCHEMA[c] for c in outputs])

    def make():
        cache = cache_of(model_path, cached_units)
        model = cache.model

        def work(texts: list) -> dict:
            aligned = model.normalizer.align_texts([text or "" for text in texts])
            ids, stops = cache.encode(aligned)
            if SPANS & set(outputs):
                begins, ends = model.project(ids, aligned)
            lists = pa.array(stops, pa.int32())
            out = {}
            for c in outputs:
                if c == "n_tokens":
                    out[c] = np.diff(stops)
                elif c == "ids":
                    out[c] = pa.ListArray.from_arrays(lists, pa.array(ids))
                elif c == "ids_text":
                    out[c] = cache.texts(ids, stops)
                elif c == "decoded":
                    out[c] = cache.decoded(ids, stops)
                elif c == "spans_sha256":
                    out[c] = [_sha256(begins[a:b], ends[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                else:
                    out[c] = pa.ListArray.from_arrays(lists, pa.array(begins if c == "begins" else ends))
            return out
        return work

    return add_columns(docs, schema, make, "text", keep)
