"""Remove every byte covered by a ``span``-byte string that starts twice or more.

Texts are cut by content: each window of ``span`` bytes belongs to the anchor with the
least hash in it, so equal windows have equal anchors at equal distances.  A window
whose anchor occurs once in the corpus cannot be repeated and leaves.  What is left is
grouped into stretches, the bytes of all windows of one anchor; equal stretches are one
with a number of copies.

The windows of the stretches are suffixes, sorted blockwise with a difference cover:

* the ranks of the cover sample - the places whose distance from the anchor has a
  remainder in the cover - are found first, by prefix doubling in steps of the period;
* the suffix buckets, one per anchor and distance, are then sorted a few at a time: by
  the first bytes, where those tie by the rank of the first sample place in both, and
  by the last bytes.  Equal neighbours are repeated windows.

Memory is bounded by ``BLOCK_BYTES`` of stretches and ``BUCKET_WINDOWS`` suffixes.  An
anchor with more than ``GROUP`` different stretches is dealt to several tasks; each
names its different windows by 128-bit digests, and these are counted across the tasks,
combined on the map side.

Defined cases: null and empty texts, and texts shorter than ``span``, lose nothing but
can be nothing's partner either; repeated rows repeat all their windows; further columns
pass through, those named as an added column give way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import Scratch
from .arrow import add_columns, slices
from .common import digest_columns
from .rolling import BASE, prefix_sums, spread, window_hashes

SPAN = 400
GRAM = 64
PERIOD = 16
GROUP = 2048
BLOCK_BYTES = 1 << 20
BUCKET_WINDOWS = 1 << 18
#: Windows of a text that are hashed at once.
SEGMENT = 1 << 22
PLACE_BITS = 23


def difference_cover(period: int) -> list[int]:
    """The first smallest set of remainders with every difference modulo ``period``."""
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = [0, *rest]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def anchors(data: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """Per anchor: its hash, its place, and the first and last window that belong to it."""
    width = span - gram + 1
    out = []
    for at in range(0, max(len(data) - span + 1, 0), SEGMENT):
        piece = data[at:at + SEGMENT + span - 1]
        hashes = window_hashes(prefix_sums(piece), gram)
        n = len(hashes)
        keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        keys[:n] = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        rows = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
        first = np.append(0, np.flatnonzero(np.diff(least)) + 1)
        place = (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        last = np.append(first[1:], len(least)) - 1
        out.append((hashes[place], place + at, first + at, last + at))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def _bytes(text) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode()


def _find_anchors(span: int):
    def run(batches):
        for part in slices(batches, 64):
            texts = part.column("text").to_pylist()
            found = [anchors(np.frombuffer(_bytes(t), dtype=np.uint8), span) for t in texts]
            counts = [len(f[0]) for f in found]
            owner = pa.array(np.repeat(np.arange(len(texts)), counts))
            h, place, first, last = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [part.column("t1").take(owner), part.column("t2").take(owner), pa.array(h.view(np.int64)), pa.array(first),
                 pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32))],
                names=["t1", "t2", "h", "first", "more", "lead"])
    return run


def _cut_stretches(span: int):
    """The bytes of all windows of each anchor."""
    def run(batches):
        for part in slices(batches, 64):
            texts = [_bytes(t) for t in part.column("text").to_pylist()]
            places = part.column("places").to_pylist()
            owner = pa.array(np.repeat(np.arange(len(texts)), [len(p) for p in places]), pa.int64())
            flat = [p for ps in places for p in ps]
            cut = [text[p["first"]:p["first"] + p["more"] + span] for text, ps in zip(texts, places) for p in ps]
            yield pa.RecordBatch.from_arrays(
                [part.column("t1").take(owner), part.column("t2").take(owner),
                 pa.array([p["h"] for p in flat], pa.int64()), pa.array([p["first"] for p in flat], pa.int64()),
                 pa.array([p["lead"] for p in flat], pa.int32()), pa.array(cut, pa.binary())],
                names=["t1", "t2", "h", "first", "lead", "bytes"])
    return run


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks from 1 of the rows of several columns."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class Block:
    """Stretches of some anchors, and the order of the windows in them."""

    def __init__(self, stretches: list[bytes], leads: np.ndarray, groups: np.ndarray, span: int, period: int = PERIOD):
        self.span, self.period, self.groups, self.leads = span, period, groups, leads
        self.cover = difference_cover(period)
        lens = np.fromiter(map(len, stretches), dtype=np.int64, count=len(stretches))
        self.starts = np.cumsum(lens) - lens
        data = np.frombuffer(b"".join(stretches) + bytes(8), dtype=np.uint8)
        self.words = np.zeros(len(data) - 7, dtype=np.uint64)  # eight bytes from each place, the first one highest
        for j in range(8):
            self.words <<= np.uint64(8)
            self.words |= data[j:len(data) - 7 + j]
        at = np.arange(len(data) - 8)
        owner = np.repeat(np.arange(len(stretches)), lens)
        offset = at - self.starts[owner]
        self.remainder = (offset - leads[owner]) % period
        counts = lens - span + 1
        self.owner = np.repeat(np.arange(len(stretches)), counts)
        self.offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.rank = self._sample_ranks(at, owner, offset, lens)

    def _sample_ranks(self, at, owner, offset, lens) -> np.ndarray:
        """For sample places the rank of the ``span - period`` bytes from there, else 0."""
        depth = self.span - self.period
        sample = np.flatnonzero(np.isin(self.remainder, self.cover) & (offset + depth <= lens[owner]))
        rank = np.zeros(len(at) + self.span, dtype=np.int64)
        inside = np.flatnonzero(np.isin(self.remainder, self.cover) & (offset + self.period <= lens[owner]))
        rank[inside] = _ranks([self.words[inside + j] for j in range(0, self.period, 8)])
        known = self.period
        while known < depth:
            step = min(known, depth - known)
            inside = inside[offset[inside] + known + step <= lens[owner[inside]]]
            pair = rank[inside] * (len(at) + 2) + rank[inside + step]
            rank_next = np.zeros_like(rank)
            rank_next[inside] = _ranks([pair])
            rank, known = rank_next, known + step
        assert len(inside) == len(sample)
        return rank

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, a number of its class, and the size of the class."""
        shift = np.array([next(d for d in range(self.period) if (r + d) % self.period in self.cover)
                          for r in range(self.period)])
        n = len(self.owner)
        distance = self.leads[self.owner] - self.offset
        bucket = self.groups[self.owner] * (2 * self.span) + distance
        by_bucket = np.argsort(bucket, kind="stable")
        label = np.empty(n, dtype=np.int64)
        edges = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        ends = np.append(edges, n)
        a, names = 0, 0
        while a < n:  # whole buckets, a bounded number of windows at once
            k = max(np.searchsorted(ends, a + BUCKET_WINDOWS, side="right") - 1, np.searchsorted(ends, a, side="right"))
            b = int(ends[min(k, len(ends) - 1)])
            own = by_bucket[a:b]
            place = self.starts[self.owner[own]] + self.offset[own]
            last = place + self.span - self.period
            label[own] = names + _ranks([
                bucket[own], *[self.words[place + j] for j in range(0, self.period, 8)],
                self.rank[place + shift[self.remainder[place]]],
                *[self.words[last + j] for j in range(0, self.period, 8)]])
            names = int(label[own].max())
            a = b
        return label, np.bincount(label)[label]


def _digests(stretch: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(stretch, dtype=np.uint8)
    one = window_hashes(prefix_sums(data), span)
    # the second half sums symbols that are spread before
    other = window_hashes(prefix_sums(spread(data.astype(np.uint64) + np.uint64(BASE))), span)
    return one.view(np.int64), other.view(np.int64)


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true flags, one after the other."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


OUT = ["c1", "c2", "runs", "w1", "w2", "single", "at"]
OUT_SCHEMA = "c1 long, c2 long, runs array<int>, w1 long, w2 long, single boolean, at int"
OUT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]


def _sort_blocks(span: int):
    def sort(rows: list[dict]):
        keys = [(r["h"], r["salt"]) for r in rows]
        groups = np.cumsum([0] + [a != b for a, b in zip(keys[1:], keys)])
        block = Block([r["bytes"] for r in rows], np.array([r["lead"] for r in rows], dtype=np.int64), groups, span)
        label, size = block.repeated()
        copies = np.array([r["copies"] for r in rows])
        flags = (size > 1) | (copies[block.owner] > 1)
        cuts = np.flatnonzero(np.diff(block.owner)) + 1
        out = []
        first_of = np.zeros(len(label) + 2, dtype=bool)
        for i, (r, own, lab, siz) in enumerate(zip(rows, np.split(flags, cuts), np.split(label, cuts), np.split(size, cuts))):
            if own.any():
                out.append((r["c1"], r["c2"], _runs(own), None, None, None, None))
            if r["salts"] > 1:  # the windows are named to the other tasks of the anchor, each once
                w1, w2 = _digests(r["bytes"], span)
                new = ~first_of[lab]
                first_of[lab] = True
                for k in np.flatnonzero(new):
                    out.append((r["c1"], r["c2"], None, int(w1[k]), int(w2[k]), not own[k], int(k)))
        return out

    def run(batches):
        held, size = [], 0
        for part in slices(batches):
            for r in part.to_pylist():
                if size >= BLOCK_BYTES and (r["h"], r["salt"]) != (held[-1]["h"], held[-1]["salt"]):
                    yield from _emit(sort(held))
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield from _emit(sort(held))
    return run


def _emit(rows: list[tuple]):
    for a in range(0, len(rows), 1 << 14):
        columns = zip(*rows[a:a + (1 << 14)])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, OUT_TYPES)], names=OUT)


SCHEMA = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _cut_out(data: bytes, found, span: int) -> tuple[int, int, bytes]:
    """Bytes and spans removed, and what is left."""
    runs = sorted({(f["first"] + a, f["first"] + b - 1 + span) for f in found or []
                   for a, b in zip(f["runs"][0::2], f["runs"][1::2])})
    kept, removed, spans, at = [], 0, 0, 0
    end = -1
    for a, b in runs:
        if a > end:
            kept.append(data[at:a])
            spans += 1
            removed += b - a
        else:
            removed += max(b - end, 0)
        end = max(end, b)
        at = end
    kept.append(data[at:])
    return removed, spans, b"".join(kept)


def suffix_dedup(docs: DataFrame, span: int = SPAN, keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, if given) with ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal runs of removed bytes) and ``kept`` (the bytes left)."""
    if span % PERIOD or span < 2 * GRAM:
        raise ValueError(f"span must be a multiple of {PERIOD} and at least {2 * GRAM}")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*digest_columns(text), text.alias("text"))

    # the windows of anchors that occur twice or more
    found = scratch.save(rows.mapInArrow(
        _find_anchors(span), "t1 long, t2 long, h long, first long, more int, lead int"), "anchors")
    twice = scratch.save(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-anchors")
    places = scratch.save(found.join(twice, "h", "left_semi").groupBy("t1", "t2").agg(
        F.collect_set(F.struct("h", "first", "more", "lead")).alias("places")), "places")
    stretches = scratch.save(
        rows.join(places, ["t1", "t2"]).mapInArrow(
            _cut_stretches(span), "t1 long, t2 long, h long, first long, lead int, bytes binary")
        .select("t1", "t2", "h", "first", "lead", "bytes", *digest_columns(F.col("bytes"), "c1", "c2")), "stretches")

    # each different stretch once, dealt by anchor and, where it has many, in parts
    distinct = scratch.save(stretches.groupBy("h", "c1", "c2").agg(
        F.count("*").alias("copies"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes")), "distinct")
    sizes = scratch.save(distinct.groupBy("h").agg(F.count("*").alias("size"), F.sum("copies").alias("all"))
                         .filter("all > 1").select("h", F.ceil(F.col("size") / GROUP).cast("int").alias("salts")), "sizes")
    dealt = distinct.join(sizes, "h").withColumn("salt", F.pmod(F.col("c1"), F.col("salts")).cast("int"))
    sorted_ = scratch.save(
        dealt.repartition("h", "salt").sortWithinPartitions("h", "salt", "c1", "c2")
        .mapInArrow(_sort_blocks(span), OUT_SCHEMA), "sorted")
    across = scratch.save(sorted_.filter("w1 is not null").groupBy("w1", "w2").agg(F.count("*").alias("n"))
                          .filter("n > 1").select("w1", "w2"), "across-tasks")
    more = sorted_.filter("single").join(across, ["w1", "w2"], "left_semi").select(
        "c1", "c2", F.array(F.col("at"), F.col("at") + 1).alias("runs"))
    runs = scratch.save(sorted_.filter("runs is not null").select("c1", "c2", "runs").unionByName(more)
                        .groupBy("c1", "c2").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")

    # back to the texts
    spans = scratch.save(
        stretches.select("t1", "t2", "first", "c1", "c2").join(runs, ["c1", "c2"])
        .groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "runs")).alias("found")), "spans")

    def make():
        def work(pairs: list) -> dict:
            data = [_bytes(p["text"]) for p in pairs]
            cut = [_cut_out(d, p["found"], span) for d, p in zip(data, pairs)]
            return {"n_bytes": [len(d) for d in data], "n_removed": [c[0] for c in cut], "n_spans": [c[1] for c in cut],
                    "kept": [c[2] for c in cut]}
        return work

    own = [c for c in docs.columns if c not in SCHEMA.names and (keep is None or c in keep)]
    joined = (docs.select(F.struct(*own).alias("_own"), text.alias("_text"), *digest_columns(text))
              .join(spans, ["t1", "t2"], "left").select("_own", F.struct(F.col("_text").alias("text"), "found").alias("_pair"))
              .select("_own.*", "_pair"))
    return add_columns(joined, SCHEMA, make, "_pair", own, 64)
