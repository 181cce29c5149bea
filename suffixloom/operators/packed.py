"""Total order of the suffixes of many whole documents, as packed arrays.

As ``ranking``, but a row holds the suffixes that a chunk of documents has in one part of
the order, a few bytes each, and numpy sorts them.  Whole documents make chunks, so what a
suffix asks for lies in its own chunk.

* First sort: the first bits of all suffixes are dealt to parts by split points; of many in
  two passes, so that the shuffle files of one are there at a time.
* A round brings the ranks to the chunks.  An open suffix has the symbols it is known to
  share with its group, ``cov``, and looks ahead by them: to the place after them, from
  there by what that place covers, and once more.  What it has seen goes back to its part,
  which holds groups whole.  A suffix that is alone there is closed; closed ones that an
  open one looks at next go along.
* The symbols before the suffixes are put together by part, in order.

Refused (``None``) is what would not fit a task: a document longer than ``LONGEST``, or a
group of equal first bits larger than several parts.  Those go row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.symbols import KEY_BITS, SEPARATOR, PrefixCode, codes_of, pack_words, symbol_column
from ..session import Scratch, free_shuffles, partitions_for
from .runs import FRAGMENT_SCHEMA, merge_runs, rl_bwt_columns, runs_of_fragments
from .suffixes import chunks

CHUNK = 1 << 19  # symbols of a chunk, a document more at most
LONGEST = 1 << 22  # longest document of a chunk
PASSES = 2  # of the first sort, each with the keys of a part of the order; more would not lower the disk of the rounds
PASSES_FROM = 1 << 26  # suffixes
KEY_STEP = 1 << 17  # suffixes whose first bits are packed at a time
HEAVY = 4  # parts that a group of equal first bits may fill
SAMPLES = 256  # keys a part from which split points are chosen
STRETCHES = 16  # places of a chunk that they are taken from
STRETCH = 1 << 11
STEPS = 3

CHUNK_SCHEMA = "raw long, size long, longest long, docs binary, lens binary, codes binary"
#: Of ``n`` suffixes of a chunk in a part: places in the chunk (the first one, and steps), first bits, symbols covered (0: all), symbol before;
#: ``tie``: documents of those that are covered whole.
KEY_SCHEMA = "part int, chunk int, n int, lead int, pos binary, k1 binary, k2 binary, cov binary, sym binary, ended int, tie binary"
#: ``rk``: rank within the part; ``cov`` is 0 for the closed ones, ``sym`` of the ``open`` ones; ``kept``: closed before.
#: One row a part (chunk -1) has the symbols ``done`` of its ``size`` suffixes closed here, by ``at`` if not of all.
MARK_SCHEMA = ("part int, chunk int, n int, lead int, pos binary, rk binary, cov binary, open int, sym binary, "
               "kept int, kept_lead int, kept_pos binary, kept_rk binary, size long, at binary, done binary")
ASK_SCHEMA = ("part int, chunk int, n int, lead int, pos binary, rk binary, n1 binary, n2 binary, n3 binary, cov binary, "
              "sym binary, kept int, kept_lead int, kept_pos binary, kept_rk binary")


def _width(most: int) -> int:
    """Bytes that numbers up to ``most`` need."""
    return next(w for w in (1, 2, 3, 4, 5, 8) if w == 8 or most < 1 << 8 * w)


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each number."""
    if width in (1, 2, 4, 8):
        return values.astype(f"<u{width}").view(np.uint8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _wide(data: np.ndarray, width: int) -> np.ndarray:
    if width in (1, 2, 4, 8):
        return data.view(f"<u{width}").astype(np.int64)
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<i8").reshape(-1)


def _blobs(values: np.ndarray, width: int, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row ``i`` has the numbers from ``bounds[i]`` to ``bounds[i + 1]``."""
    data = _narrow(values, width)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(data)])


def _unblob(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """All numbers of a binary column whose rows have ``n`` numbers each, as many bytes as the row needs."""
    if not n.any():
        return np.empty(0, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data, rows = np.frombuffer(column.buffers()[2], dtype=np.uint8), np.flatnonzero(n)
    widths = np.diff(offsets)[rows] // n[rows]
    if widths.min() == widths.max():
        return _wide(data[offsets[0]:offsets[-1]].copy(), int(widths[0]))
    return np.concatenate([_wide(data[offsets[i]:offsets[i + 1]].copy(), int(w)) for i, w in zip(rows, widths)])


def _places(pos: np.ndarray, bounds: np.ndarray, of: str = "") -> dict:
    """Columns of ascending places: the first of each row, and the steps from one to the next."""
    n = np.diff(bounds)
    first, step, lead = bounds[:-1][n > 0], np.diff(pos, prepend=0), np.zeros(len(n), dtype=np.int32)
    lead[n > 0], step[first] = pos[first], 0
    return {f"{of}lead": lead, f"{of}pos": _blobs(step, _width(int(step.max(initial=0))), bounds)}


def _read_places(batch: pa.RecordBatch, n: np.ndarray, of: str = "") -> np.ndarray:
    upto, some = np.cumsum(_unblob(batch.column(f"{of}pos"), n)), n > 0
    if len(upto):
        upto += np.repeat(_ints(batch, f"{of}lead")[some] - upto[(np.cumsum(n) - n)[some]], n[some])
    return upto


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _table(ddl: str, columns: dict) -> pa.RecordBatch:
    schema = _arrow(ddl)
    rows = len(columns["part"])
    arrays = [columns[f.name] if isinstance(columns.get(f.name), pa.Array)
              else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _chunk_rows(collection: DataFrame, code: PrefixCode, width: int) -> DataFrame:
    """One row per chunk: its documents, their lengths, and their symbols as places of words."""

    def run(batches):
        table, task = code.table(), TaskContext.get().partitionId()
        for seq, (docs, texts) in enumerate(chunks(batches, CHUNK)):
            lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
            yield _row(_arrow(CHUNK_SCHEMA), raw=(task << 32) + seq, size=int(lens.sum()) + len(lens), longest=int(lens.max()),
                       docs=docs.tobytes(), lens=lens.tobytes(), codes=_narrow(table[codes_of(texts)], width).tobytes())

    return collection.select("doc", "text").mapInArrow(run, CHUNK_SCHEMA)


class _Chunk:
    """The positions of a chunk: the symbols of each document and its end."""

    def __init__(self, docs: bytes, lens: bytes, codes: bytes, width: int):
        self.docs, self.lens = np.frombuffer(docs, dtype=np.int64), np.frombuffer(lens, dtype=np.int64)
        codes = _wide(np.frombuffer(codes, dtype=np.uint8), width)
        ends = np.cumsum(self.lens + 1) - 1
        self.starts = ends - self.lens
        self.size = int(ends[-1]) + 1
        self.end = np.repeat(ends, self.lens + 1)
        self.dense = np.zeros(self.size, dtype=np.int64)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(self.lens)), self.lens)
        self.dense[at] = codes
        self.before = np.zeros(self.size + 1, dtype=np.int64)  # 0 stands for the separator
        self.before[at + 1] = codes
        self.before = self.before[:-1]
        self.before[self.starts] = 0

    def doc(self, pos: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.starts, pos, side="right") - 1]

    def keys(self, lo: int, hi: int, code: PrefixCode):
        """``k1, k2, cov, tie`` of the positions from ``lo`` to ``hi``."""
        top = min(hi + KEY_BITS, self.size)
        dense, at = self.dense[lo:top], np.arange(hi - lo)
        end = np.minimum(self.end[lo:hi] - lo, len(dense))
        (k1, k2), ended = pack_words(dense, at, end, code)
        stop = np.cumsum(np.array(code.sizes, dtype=np.int64)[dense])
        cov = np.searchsorted(stop, np.append(0, stop)[at] + KEY_BITS, side="right") - at
        cov[ended] = 0
        tie = np.zeros(hi - lo, dtype=np.int64)
        tie[ended] = self.doc(lo + np.flatnonzero(ended))
        return k1, k2, cov, tie


def _read_chunks(batches, width: int):
    for batch in batches:
        columns = [batch.column(c) for c in ("raw", "docs", "lens", "codes")]
        for i in range(batch.num_rows):
            raw, *parts = (c[i].as_py() for c in columns)
            yield raw, _Chunk(*parts, width)


@dataclass(frozen=True)
class _Splits:
    """The least key of each part but the first, ascending by ``k1, k2, tie``."""

    k1: np.ndarray
    k2: np.ndarray
    tie: np.ndarray

    def parts(self, k1: np.ndarray, k2: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """How many splits are not above each key."""
        lo, hi = np.searchsorted(self.k1, k1, side="left"), np.searchsorted(self.k1, k1, side="right")
        same = np.flatnonzero(lo < hi)
        a, b, k2, tie = lo[same], hi[same], k2[same], tie[same]
        while len(a) and (a < b).any():
            mid = np.minimum((a + b) // 2, len(self.k1) - 1)
            upto = (self.k2[mid] < k2) | ((self.k2[mid] == k2) & (self.tie[mid] <= tie))
            a, b = np.where((a < b) & upto, mid + 1, a), np.where((a < b) & ~upto, mid, b)
        lo[same] = a
        return lo


def _choose(table: DataFrame, code: PrefixCode, width: int, parts: int, chunk_count: int) -> _Splits | None:
    """Split points of about equal parts, from some keys of each chunk; none if a group is too large."""
    each = min(STRETCH, max(4, -(-SAMPLES * parts // (chunk_count * STRETCHES))))

    def sample(batches):
        for _, chunk in _read_chunks(batches, width):
            for s in range(STRETCHES):
                lo, hi = s * chunk.size // STRETCHES, (s + 1) * chunk.size // STRETCHES
                hi = min(hi, lo + STRETCH)
                if lo < hi:
                    k1, k2, _, tie = chunk.keys(lo, hi, code)
                    pick = np.unique(np.arange(each) * (hi - lo) // each)
                    yield pa.RecordBatch.from_pydict({"k1": k1[pick], "k2": k2[pick], "tie": tie[pick]})

    keys = table.mapInArrow(sample, "k1 long, k2 long, tie long").toArrow()  # SAMPLES rows a part, or those of each chunk
    k1, k2, tie = (keys[c].to_numpy() for c in ("k1", "k2", "tie"))
    order = np.lexsort((tie, k2, k1))
    pick = order[np.arange(1, parts) * len(order) // parts]
    rows, times = np.unique(np.stack([k1[pick], k2[pick], tie[pick]]), axis=1, return_counts=True)
    if times.max(initial=1) > HEAVY:
        return None
    order = np.lexsort((rows[2], rows[1], rows[0]))
    return _Splits(*(r[order] for r in rows))


def _deal(splits: _Splits, code: PrefixCode, width: int, raws: np.ndarray, lo_part: int, hi_part: int):
    """The keys of a chunk, by parts from ``lo_part`` to ``hi_part``."""

    def run(batches):
        for raw, chunk in _read_chunks(batches, width):
            got = []
            for lo in range(0, chunk.size, KEY_STEP):
                hi = min(lo + KEY_STEP, chunk.size)
                k1, k2, cov, tie = chunk.keys(lo, hi, code)
                part = splits.parts(k1, k2, tie)
                mine = slice(None) if hi_part - lo_part > len(splits.k1) else np.flatnonzero((part >= lo_part) & (part < hi_part))
                got.append((part[mine].astype(np.int32), np.arange(lo, hi)[mine], k1[mine], k2[mine],
                            cov[mine].astype(np.uint8), tie[mine]))
            part, pos, k1, k2, cov, tie = (np.concatenate(c) for c in zip(*got))
            del got
            if not len(part):
                continue
            order = np.argsort(part if len(splits.k1) >= 1 << 15 else part.astype(np.int16), kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            bounds = np.append(first, len(part))
            pos, cov = pos[order], cov[order]
            whole = cov == 0
            ended = np.append(0, np.cumsum(whole))[bounds]
            yield _table(KEY_SCHEMA, {
                "part": part[first], "chunk": np.full(len(first), np.searchsorted(raws, raw)), "n": np.diff(bounds),
                **_places(pos, bounds), "k1": _blobs(k1[order], 8, bounds), "k2": _blobs(k2[order], 8, bounds),
                "cov": _blobs(cov, 1, bounds), "sym": _blobs(chunk.before[pos], width, bounds),
                "ended": np.diff(ended), "tie": _blobs(tie[order][whole], 8, ended)})

    return run


def _marks(part: int, chunk, n, pos, rank, cov, sym, width: int) -> dict:
    """Rows of ``MARK_SCHEMA`` by blobs of ``n`` suffixes."""
    bounds = np.append(0, np.cumsum(n))
    is_open = cov > 0
    opened = np.append(0, np.cumsum(is_open))[bounds]
    return {"part": np.full(len(chunk), part), "chunk": chunk, "n": n, **_places(pos, bounds),
            "rk": _blobs(rank, _width(int(rank.max(initial=0))), bounds), "cov": _blobs(cov, _width(int(cov.max(initial=0))), bounds),
            "open": np.diff(opened), "sym": _blobs(sym[is_open], width, opened)}


def _ranks(new: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, where ``new`` ones start: the row that each one's start is, less that of its ``group``, and which are alone."""
    at = np.arange(len(new))
    start = np.maximum.accumulate(np.where(new, at, 0))
    if group is not None:
        start -= np.maximum.accumulate(np.where(group, at, 0))
    return start, new & np.append(new[1:], True)


def _sort_keys(width: int):
    """Rank the suffixes of a part by their first bits."""

    def run(batches):
        got, part = [], 0
        for batch in batches:
            if batch.num_rows:
                part, n, ended = batch.column("part")[0].as_py(), _ints(batch, "n"), _ints(batch, "ended")
                got.append((_ints(batch, "chunk"), n, _read_places(batch, n), *(_unblob(batch.column(c), n) for c in ("k1", "k2", "cov", "sym")),
                            _unblob(batch.column("tie"), ended)))
        if not got:
            return
        chunk, n, pos, k1, k2, cov, sym, tie = (np.concatenate(c) for c in zip(*got))
        del got
        ties = np.zeros(len(pos), dtype=np.int64)
        ties[cov == 0] = tie
        order = np.argsort(k1)
        same = k1[order]
        same = same[1:] == same[:-1]
        some = np.flatnonzero(np.append(same, False) | np.append(False, same))
        sub = order[some]
        order[some] = sub[np.lexsort((ties[sub], k2[sub], k1[sub]))]
        a, b = k1[order], k2[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) | (cov[order] == 0)
        del a, b, k1, k2, ties
        start, alone = _ranks(new)
        rank = np.empty_like(start)
        rank[order] = start
        cov[order[alone]] = 0
        yield _table(MARK_SCHEMA, _marks(part, chunk, n, pos, rank, cov, sym, width))
        yield _row(_arrow(MARK_SCHEMA), part=part, chunk=-1, n=0, open=0, kept=0, size=len(pos),
                   done=_narrow(sym[order], width).tobytes())

    return run


def _ask(starts: np.ndarray, rows: int, width: int):
    """What the open suffixes of each chunk see ahead, by their parts; the rows of a chunk follow each other."""
    rank_width = _width(rows)

    def look(chunk: int, got: list):
        pos, rank, cov, sym = (np.concatenate(c) for c in zip(*got))
        size = int(pos.max()) + 1
        ranks, covers, syms = (np.zeros(size, dtype=np.int64) for _ in range(3))
        ranks[pos], covers[pos], syms[pos] = rank, cov, sym
        p = np.flatnonzero(covers)
        if not len(p):
            return
        at, seen, cover, on = p, [], covers[p], np.ones(len(p), dtype=bool)
        total = cover.copy()
        closed = np.zeros(size, dtype=bool)
        for step in range(STEPS):
            at = np.where(on, at + cover, at)
            seen.append(np.where(on, ranks[at], 0))
            cover = np.where(on, covers[at], 0)
            if step == 0:
                closed[at[cover == 0]] = True
            total += cover
            on = cover > 0
        kept = np.flatnonzero(closed)
        part, kept_part = (np.searchsorted(starts, ranks[x], side="right") - 1 for x in (p, kept))
        order, kept_order = np.argsort(part, kind="stable"), np.argsort(kept_part, kind="stable")
        p, part, kept, kept_part = p[order], part[order], kept[kept_order], kept_part[kept_order]
        parts = np.union1d(part, kept_part)
        bounds = np.append(np.searchsorted(part, parts), len(part))
        kept_bounds = np.append(np.searchsorted(kept_part, parts), len(kept_part))
        own, kept_own = ranks[p] - starts[part], ranks[kept] - starts[kept_part]
        most = _width(int(max(own.max(), kept_own.max(initial=0))))
        yield _table(ASK_SCHEMA, {
            "part": parts, "chunk": np.full(len(parts), chunk), "n": np.diff(bounds), **_places(p, bounds),
            "rk": _blobs(own, most, bounds), **{f"n{j + 1}": _blobs(s[order], rank_width, bounds) for j, s in enumerate(seen)},
            "cov": _blobs(total[order], _width(int(total.max())), bounds), "sym": _blobs(syms[p], width, bounds),
            "kept": np.diff(kept_bounds), **_places(kept, kept_bounds, "kept_"),
            "kept_rk": _blobs(kept_own, most, kept_bounds)})

    def run(batches):
        last, got = None, []
        for batch in batches:
            chunk, part, n, opened, kept = (_ints(batch, c) for c in ("chunk", "part", "n", "open", "kept"))
            if not len(chunk):
                continue
            edges = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if last is not None and chunk[lo] != last:
                    yield from look(last, got)
                    got = []
                last, rows_of = int(chunk[lo]), batch.slice(lo, hi - lo)
                pos = _read_places(rows_of, n[lo:hi])
                rank, cov = (_unblob(rows_of.column(c), n[lo:hi]) for c in ("rk", "cov"))
                sym = np.zeros(len(pos), dtype=np.int64)
                sym[cov > 0] = _unblob(rows_of.column("sym"), opened[lo:hi])
                got.append((pos, rank + np.repeat(starts[part[lo:hi]], n[lo:hi]), cov, sym))
                if kept[lo:hi].any():
                    pos, rank = _read_places(rows_of, kept[lo:hi], "kept_"), _unblob(rows_of.column("kept_rk"), kept[lo:hi])
                    none = np.zeros(len(pos), dtype=np.int64)
                    got.append((pos, rank + np.repeat(starts[part[lo:hi]], kept[lo:hi]), none, none))
        if last is not None:
            yield from look(last, got)

    return run


def _refine(width: int):
    """Refine the ranks of a part by what its open suffixes have seen."""

    def run(batches):
        got, kept, part = [], [], 0
        for batch in batches:
            if batch.num_rows:
                part, n, k = batch.column("part")[0].as_py(), _ints(batch, "n"), _ints(batch, "kept")
                got.append((_ints(batch, "chunk"), n, _read_places(batch, n),
                            *(_unblob(batch.column(c), n) for c in ("rk", "n1", "n2", "n3", "cov", "sym"))))
                kept.append((k, _read_places(batch, k, "kept_"), _unblob(batch.column("kept_rk"), k)))
        if not got:
            return
        chunk, n, pos, rank, n1, n2, n3, cov, sym = (np.concatenate(c) for c in zip(*got))
        kept, kept_pos, kept_rank = (np.concatenate(c) for c in zip(*kept))
        del got
        order = np.lexsort((n3, n2, n1, rank))
        keys = [c[order] for c in (rank, n1, n2, n3)]
        group = np.append(True, keys[0][1:] != keys[0][:-1])[:len(order)]
        new = group.copy()
        for c in keys[1:]:
            new[1:] |= c[1:] != c[:-1]
        shift, alone = _ranks(new, group) if len(order) else (new.astype(np.int64), new)
        rank[order] += shift
        cov[order[alone]] = 0
        bounds = np.append(0, np.cumsum(kept))
        rows = _marks(part, chunk, n, pos, rank, cov, sym, width)
        yield _table(MARK_SCHEMA, rows | {"kept": kept, **_places(kept_pos, bounds, "kept_"),
                                          "kept_rk": _blobs(kept_rank, _width(int(kept_rank.max(initial=0))), bounds)})
        gone = order[alone]
        yield _row(_arrow(MARK_SCHEMA), part=part, chunk=-1, n=0, open=0, kept=0, size=len(gone),
                   at=_narrow(rank[gone], 4).tobytes(), done=_narrow(sym[gone], width).tobytes())

    return run


def _assembled(batches, width: int):
    """Of one part: its symbols in order, from the rows of the first sort and of the rounds."""
    whole, later, part = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            part = row["part"]
            done = _wide(np.frombuffer(row["done"], dtype=np.uint8), width)
            if row["at"] is None:
                whole = done.copy()
            else:
                later.append((_wide(np.frombuffer(row["at"], dtype=np.uint8), 4), done))
    if whole is None:
        return
    for at, done in later:
        whole[at] = done
    yield part, whole


@dataclass
class PackedSuffixes:
    """All suffixes in order: ``done (part, size, at, done)``, one row for a part and round."""

    chunks: DataFrame
    marks: list[DataFrame]
    raws: np.ndarray
    starts: np.ndarray
    rows: int
    parts: int
    symbols: tuple[int, ...]
    width: int
    scratch: Scratch

    def _by_part(self, emit, schema: str) -> DataFrame:
        """Rows that ``emit`` makes of each part and its symbols in order."""
        width = self.width
        done = self.marks[0]
        for more in self.marks[1:]:
            done = done.unionByName(more)
        done = done.filter("done is not null").select("part", "at", "done").repartitionById(self.parts, "part")

        def run(batches):
            for part, places in _assembled(batches, width):
                yield from emit(part, places)

        return done.mapInArrow(run, schema)

    def _lookup(self) -> np.ndarray:
        return np.array([SEPARATOR, *self.symbols], dtype=np.int64)

    def bwt(self) -> DataFrame:
        starts, codes = self.starts, self._lookup()

        def emit(part, places):
            for lo in range(0, len(places), 1 << 16):
                own = places[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"bwt_idx": starts[part] + lo + np.arange(len(own)),
                                                  "sym": codes[own].astype(np.int32)})

        return self._by_part(emit, "bwt_idx long, sym int").select("bwt_idx", symbol_column(F.col("sym")).alias("ch"))

    def runs(self) -> DataFrame:
        codes = self._lookup()

        def emit(_, places):
            first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            yield from merge_runs([pa.RecordBatch.from_pydict({
                "sym": codes[places[first]].astype(np.int32), "weight": np.diff(np.append(first, len(places)))})])

        return runs_of_fragments(self._by_part(emit, FRAGMENT_SCHEMA), self.scratch)

    def rl_bwt(self) -> DataFrame:
        return rl_bwt_columns(self.runs())

    @property
    def suffixes(self) -> DataFrame:
        """``doc, off, sym, rank``: the ranks found in each round are brought to the chunks' documents."""
        raws, starts, width, codes = self.raws, self.starts, self.width, self._lookup()
        tasks = partitions_for(self.chunks.sparkSession, self.rows)
        found = self.marks[0]
        for more in self.marks[1:]:
            found = found.unionByName(more)
        found = found.filter("chunk >= 0").select("chunk", "part", "n", "lead", "pos", "rk", "cov")

        def number(batches):
            for batch in batches:
                own = np.searchsorted(raws, _ints(batch, "raw")).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), *(batch.column(c) for c in ("docs", "lens", "codes"))],
                                                 ["chunk", "docs", "lens", "codes"])

        texts = self.chunks.select("raw", "docs", "lens", "codes").mapInArrow(number, "chunk int, docs binary, lens binary, codes binary")

        def run(batches):
            chunk = None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    if row.column("docs")[0].is_valid:
                        chunk = _Chunk(*(row.column(c)[0].as_py() for c in ("docs", "lens", "codes")), width)
                        continue
                    n = _ints(row, "n")
                    rank, cov = (_unblob(row.column(c), n) for c in ("rk", "cov"))
                    closed = cov == 0
                    pos, rank = _read_places(row, n)[closed], rank[closed] + starts[row.column("part")[0].as_py()]
                    own = np.searchsorted(chunk.starts, pos, side="right") - 1
                    yield pa.RecordBatch.from_pydict({"doc": chunk.docs[own], "off": pos - chunk.starts[own],
                                                      "sym": codes[chunk.before[pos]].astype(np.int32), "rank": rank})

        both = texts.unionByName(found, allowMissingColumns=True)
        return (both.repartitionById(tasks, F.expr(f"cast(chunk % {tasks} as int)"))
                .sortWithinPartitions("chunk", F.col("docs").isNull()).mapInArrow(run, "doc long, off long, sym int, rank long"))

    def close(self) -> None:
        """Drop the tables behind the ranks."""
        self.scratch.delete()


def pack_suffixes(collection: DataFrame, code: PrefixCode, rows: int, scratch: Scratch) -> PackedSuffixes | None:
    """Rank every one of the ``rows`` suffixes of ``collection (doc, text)``, whose keys differ."""
    spark = collection.sparkSession
    width = _width(len(code.codes))
    table = scratch.save(_chunk_rows(collection, code, width), "chunks")
    sizes = sorted(map(tuple, table.select("raw", "size", "longest").collect()))  # one row per chunk
    if not sizes or max(s[2] for s in sizes) > LONGEST:
        return None
    raws = np.array([s[0] for s in sizes])
    texts = table.select("raw", "docs", "lens", "codes")
    splits = _choose(texts, code, width, partitions_for(spark, rows), len(sizes))
    if splits is None:
        return None
    parts = len(splits.k1) + 1
    marks, held, passes = None, {}, PASSES if parts >= PASSES and rows >= PASSES_FROM else 1
    for i in range(passes):
        lo, hi = i * parts // passes, (i + 1) * parts // passes
        own = scratch.save(  # nothing but the saved table is held on to, so the shuffle files can go
            texts.mapInArrow(_deal(splits, code, width, raws, lo, hi), KEY_SCHEMA)
            .repartitionById(hi - lo, F.expr(f"part - {lo}")).mapInArrow(_sort_keys(width), MARK_SCHEMA), "packed-ranks")
        held |= dict(map(tuple, own.filter("size is not null").select("part", "size").collect()))  # one row per part
        free_shuffles(spark, rows)
        marks = own if marks is None else marks.unionByName(own)
    starts = np.cumsum([0] + [held.get(p, 0) for p in range(parts)])[:-1]
    every, total = [marks], rows
    while left := marks.filter("chunk >= 0").agg(F.sum("open")).first()[0]:
        free_shuffles(spark, total)
        total = min(rows, 2 * left) if marks is not every[0] else rows
        tasks = partitions_for(spark, total)
        marks = scratch.save(
            marks.filter("chunk >= 0").drop("size", "at", "done").repartitionById(tasks, F.expr(f"cast(chunk % {tasks} as int)"))
            .sortWithinPartitions("chunk").mapInArrow(_ask(starts, rows, width), ASK_SCHEMA)
            .repartitionById(parts, "part").mapInArrow(_refine(width), MARK_SCHEMA), "packed-ranks")
        every.append(marks)
    free_shuffles(spark, total)
    return PackedSuffixes(table, every, raws, starts, rows, parts, code.codes, width, scratch)
