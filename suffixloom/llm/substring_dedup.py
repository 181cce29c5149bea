"""Remove the words under windows of ``window`` words that also start in an earlier document.

Documents are streamed through suffix automata of reference shards.  The reference is the
corpus itself, so it is cut by content first: each window belongs to the anchor, the run
of ``GRAM`` words with the least hash in it, and equal windows have equal anchors.  The
windows of one anchor that follow each other are a stretch.  Anchors of a single document
leave; equal stretches are one, with the least and the greatest id of its documents.  One
that is the only one of its anchor needs no automaton: all its windows are in all these.

A shard holds the stretches of some anchors.  Its automaton is built word by word; every
state knows the least and the greatest id of the documents in which its strings occur.
Streaming a stretch gives matching statistics: after each word the longest suffix that is
in the shard, and its state.  Where at least ``window`` words match, the state of exactly
that many words tells the first document with this window.  Windows known to several
documents make spans, which are judged against the id of each document they are in.

Scale: an automaton goes to one task with all stretches that could match in it, not to
all tasks: a reference that is the corpus has no size bound for a broadcast, and a
stretch can only match among those of its anchor.  A task holds ``SHARD_WORDS`` words and
one group more.  A group with more than ``GROUP`` different stretches is dealt anew, by
the ``FINER`` least grams of each window, and what is still too large by whole windows,
of which a group has one.  Documents are exchanged twice, by the digest of their text.

Defined cases: null, empty and short texts lose nothing; documents with one id are not
earlier than each other, nor are those without an id, which come after all others;
repeated rows are judged alike; further columns pass through, those named as an added
column give way.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import Scratch
from .arrow import add_columns, slices
from .common import digest_columns
from .rolling import BASE, INVERSE, powers, prefix_sums, shingle_hashes, spread, word_hashes

WINDOW = 50
GRAM = 8
FINER = 4
GROUP = 512
SHARD_WORDS = 1 << 16
#: Windows of a text that are looked at at once.
SEGMENT = 1 << 22
PLACE_BITS = 23
#: Windows of a stretch that is cut by more than its anchor.
RUN = 64
LAST_ID = (1 << 63) - 1


# --- stretches ---

def _digests(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each run of words ``first .. stop - 1``."""
    out = []
    for symbols in (words, spread(words ^ np.uint64(BASE))):
        sums = prefix_sums(symbols)
        out.append(spread((sums[stop] - sums[first]) * powers(INVERSE, len(words) + 1)[first] + (stop - first).astype(np.uint64)))
    return out[0], out[1]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(words: np.ndarray, owner: np.ndarray, window: int):
    """Per stretch: hash of its anchor, first window and number of windows.  ``owner``
    ascends and tells the texts apart; no window crosses them."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(words) - window + 1, SEGMENT):
        piece, own = words[at:at + SEGMENT + window - 1], owner[at:at + SEGMENT + window - 1]
        grams = shingle_hashes(piece, GRAM)
        places = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
        least = _least(places, window - GRAM + 1)
        inside = own[:len(least)] == own[window - 1:]
        new = np.append(True, (least[1:] != least[:-1]) | ~inside[:-1])
        first = np.flatnonzero(new & inside)
        ends = np.append(np.flatnonzero(new | ~inside), len(least))
        place = (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        out.append((grams[place], first + at, ends[np.searchsorted(ends, first, side="right")] - first))
    return tuple(np.concatenate(c) for c in zip(*out))


def finer_stretches(words: np.ndarray, owner: np.ndarray, window: int, level: int):
    """As ``anchors``, by the ``FINER`` least grams of each window; on the last level each window is by itself."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = owner[:n] == owner[window - 1:]
    starts = np.arange(n)
    if level == LEVELS:
        first = starts[inside]
        return _digests(words, first, first + window)[0], first, np.ones(len(first), np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(shingle_hashes(words, GRAM), window - GRAM + 1)
    low = np.sort(np.partition(grams, FINER - 1, axis=1)[:, :FINER], axis=1)
    key = np.zeros(n, np.uint64)
    for k in range(FINER):
        key = spread(key * np.uint64(BASE) + low[:, k])
    new = np.append(True, (key[1:] != key[:-1]) | ~inside[:-1]) | (starts % RUN == 0)
    first = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new | ~inside), n)
    return key[first], first, ends[np.searchsorted(ends, first, side="right")] - first


LEVELS = 3


def _find(window: int):
    """The stretches of all texts, without their words."""
    def run(batches):
        for part in slices(batches):
            words, counts = word_hashes([(t or "").encode() for t in part.column("text").to_pylist()])
            owner = np.repeat(np.arange(len(counts)), counts)
            h, first, n = anchors(words, owner, window)
            c1, c2 = _digests(words, first, first + n + window - 1)
            row = owner[first]
            begin = np.cumsum(counts) - counts
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(take) for c in ("t1", "t2", "id")), pa.array(h.view(np.int64)), pa.array(c1.view(np.int64)),
                 pa.array(c2.view(np.int64)), pa.array(first - begin[row]), pa.array(n.astype(np.int32))],
                names=["t1", "t2", "id", "h", "c1", "c2", "first", "n"])
    return run


def _cut(window: int):
    """The words, as hashes, of the stretches that a text stands for."""
    def run(batches):
        for part in slices(batches, 64):
            words, counts = word_hashes([(t or "").encode() for t in part.column("text").to_pylist()])
            begin = np.cumsum(counts) - counts
            places = part.column("places").to_pylist()
            flat = [p for own in places for p in own]
            at = np.repeat(begin, [len(own) for own in places])
            cut = [words[a + p["first"]:a + p["first"] + p["n"] + window - 1].tobytes() for a, p in zip(at.tolist(), flat)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[c] for p in flat], pa.int64()) for c in ("h", "c1", "c2", "low", "high")]
                + [pa.array(cut, pa.binary())], names=["h", "c1", "c2", "low", "high", "words"])
    return run


def _cut_finer(window: int, level: int):
    def run(batches):
        for part in slices(batches):
            rows = [np.frombuffer(w, np.uint64) for w in part.column("words").to_pylist()]
            counts = np.array([len(r) for r in rows])
            words, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), counts)
            h, first, n = finer_stretches(words, owner, window, level)
            stop = first + n + window - 1
            c1, c2 = _digests(words, first, stop)
            row = owner[first]
            take, begin = pa.array(row), np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(take) for c in ("c1", "c2")), pa.array((first - begin[row]).astype(np.int64)),
                 pa.array(h.view(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                 *(part.column(c).take(take) for c in ("low", "high")),
                 pa.array([words[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist())], pa.binary())],
                names=["p1", "p2", "at", "h", "c1", "c2", "low", "high", "words"])
    return run


# --- automata ---

class Automaton:
    """The suffix automaton of several word rows; each state with the least and the
    greatest id of the documents that its strings occur in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._low, self._high = [LAST_ID], [-LAST_ID - 1]

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self._low.append(LAST_ID)
        self._high.append(-LAST_ID - 1)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of ``q`` that are as long as ``p`` and the word, or shorter."""
        shorter = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        self.link[q] = shorter
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = shorter
            p = self.link[p]
        return shorter

    def add(self, words: list[int], low: int, high: int) -> None:
        next_, link, length, lows, highs = self.next, self.link, self.length, self._low, self._high
        last = 0
        for word in words:
            q = next_[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            else:
                new = len(link)
                next_.append({})
                link.append(0)
                length.append(length[last] + 1)
                lows.append(LAST_ID)
                highs.append(-LAST_ID - 1)
                p = last
                while p >= 0 and word not in next_[p]:
                    next_[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = next_[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if low < lows[last]:
                lows[last] = low
            if high > highs[last]:
                highs[last] = high

    def finish(self) -> None:
        """Carry the ids over to the shorter strings; to be called after the last row."""
        self.links, self.lengths = np.array(self.link), np.array(self.length)
        self.low, self.high = np.array(self._low), np.array(self._high)
        order = np.argsort(-self.lengths, kind="stable")[:-1]  # the root stays
        for level in np.split(order, np.flatnonzero(np.diff(self.lengths[order])) + 1):
            np.minimum.at(self.low, self.links[level], self.low[level])
            np.maximum.at(self.high, self.links[level], self.high[level])

    def matching_statistics(self, words: list[int]) -> tuple[list[int], list[int]]:
        """After each word: state and length of the longest suffix that is in the automaton."""
        next_, link, length = self.next, self.link, self.length
        states, lengths, state, n = [], [], 0, 0
        for word in words:
            to = next_[state].get(word)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = next_[state].get(word)
            if to is not None:
                state, n = to, n + 1
            states.append(state)
            lengths.append(n)
        return states, lengths

    def windows(self, words: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest id of the documents with each window of the row; where
        none has it, the greatest is below the least."""
        states, lengths = (np.array(x[window - 1:], np.int64) for x in self.matching_statistics(words))
        matched = lengths >= window
        states = np.where(matched, states, 0)
        while True:  # up to the state of exactly that many words
            up = self.lengths[np.maximum(self.links[states], 0)] >= window
            if not up.any():
                break
            states = np.where(up, self.links[states], states)
        return np.where(matched, self.low[states], LAST_ID), np.where(matched, self.high[states], -LAST_ID - 1)


RUNS = "array<struct<a:int,b:int,low:bigint>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("low", pa.int64())]))


def _runs(low: np.ndarray, high: np.ndarray) -> list[dict]:
    """Runs of windows with one first document that are in other documents too."""
    shared = low < high
    edge = np.append(True, (low[1:] != low[:-1]) | (shared[1:] != shared[:-1]))
    first = np.flatnonzero(edge)
    stop = np.append(first[1:], len(low))
    keep = shared[first]
    return [{"a": a, "b": b, "low": d} for a, b, d in zip(
        first[keep].tolist(), stop[keep].tolist(), low[first[keep]].tolist())]


def _stream(window: int):
    """Build the automata of shards, whole groups each, and stream the stretches through."""
    def judge(rows: list[tuple]):
        words = [np.frombuffer(r[5], np.uint64) for r in rows]
        sizes = [len(w) for w in words]
        symbols = np.unique(np.concatenate(words), return_inverse=True)[1].tolist()
        automaton, at, own = Automaton(), 0, []
        for r, n in zip(rows, sizes):
            own.append(symbols[at:at + n])
            automaton.add(own[-1], r[3], r[4])
            at += n
        automaton.finish()
        found = [(r[1], r[2], _runs(*automaton.windows(o, window))) for r, o in zip(rows, own)]
        return [f for f in found if f[2]]

    def batch(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
             pa.array([f[2] for f in found], _RUNS)], names=["c1", "c2", "runs"])

    def run(batches):
        held, size = [], 0
        for part in slices(batches):
            for r in zip(*(part.column(c).to_pylist() for c in ("h", "c1", "c2", "low", "high", "words"))):
                if size >= SHARD_WORDS and r[0] != held[-1][0]:
                    yield batch(judge(held))
                    held, size = [], 0
                held.append(r)
                size += len(r[5]) // 8
        if held:
            yield batch(judge(held))
    return run


def _judged(distinct: DataFrame, window: int, scratch: Scratch, level: int = 1) -> DataFrame:
    """``c1, c2, runs`` of the stretches ``h, c1, c2, low, high, words``."""
    sizes = scratch.save(distinct.groupBy("h").agg(F.count("*").alias("size")).filter(f"size > {GROUP}").select("h"), "hot-groups") \
        if level < LEVELS else None
    hot = 0 if sizes is None else sizes.count()
    cold = distinct.join(sizes, "h", "left_anti") if hot else distinct
    out = scratch.save(cold.repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(
        _stream(window), f"c1 long, c2 long, runs {RUNS}"), "runs")
    if not hot:
        return out
    schema = "p1 long, p2 long, at long, h long, c1 long, c2 long, low long, high long, words binary"
    finer = scratch.save(distinct.join(sizes, "h", "left_semi").repartition("c1", "c2").mapInArrow(
        _cut_finer(window, level + 1), schema), "finer")
    shared = scratch.save(finer.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                          .filter("low < high").select("h"), "finer-groups")
    once = scratch.save(finer.join(shared, "h", "left_semi").groupBy("h", "c1", "c2").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.first("words").alias("words")), "finer-distinct")
    found = _judged(once, window, scratch, level + 1)
    shifted = F.transform("runs", lambda r: F.struct(
        (r["a"] + F.col("at")).cast("int").alias("a"), (r["b"] + F.col("at")).cast("int").alias("b"), r["low"].alias("low")))
    back = (finer.select("p1", "p2", "at", "c1", "c2").join(found, ["c1", "c2"])
            .groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.flatten(F.collect_list(shifted)).alias("runs")))
    return scratch.save(out.unionByName(back.withColumn("runs", F.col("runs").cast(RUNS))), "all-runs")


# --- documents ---

SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("repeats", T.BooleanType())])


def _cover(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` words are under the spans (start, end)."""
    steps = np.zeros(n + 1, np.int64)
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    return np.cumsum(steps)[:n] > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``docs (doc_id, text, ..)`` (of it the columns ``keep``, if given) with ``n_words``, ``n_removed``,
    ``n_spans`` (maximal runs of removed words), ``kept`` (the other words, joined by one space) and
    ``repeats`` (whether a window is also in another document, earlier or later)."""
    if window < 2 * GRAM:
        raise ValueError(f"a window must have at least {2 * GRAM} words")
    scratch = scratch or Scratch(docs.sparkSession)
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    rows = docs.select(*digest_columns(text), id_.alias("id"), text.alias("text"))

    found = scratch.save(rows.mapInArrow(
        _find(window), "t1 long, t2 long, id long, h long, c1 long, c2 long, first long, n int"), "stretches")
    shared = scratch.save(found.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                          .filter("low < high").select("h"), "anchors")
    several = scratch.save(found.join(shared, "h", "left_semi"), "shared-stretches")
    # a stretch is read from its first document
    reader = F.min(F.struct("id", "t1", "t2", "first", "n"))
    once = several.groupBy("h", "c1", "c2").agg(reader.alias("r"), F.max("id").alias("high"))
    once = scratch.save(once.select("h", "c1", "c2", F.col("r.id").alias("low"), "high", "r.t1", "r.t2", "r.first", "r.n"), "distinct")
    groups = scratch.save(once.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1").select("h"), "groups")
    places = once.join(groups, "h", "left_semi").groupBy(F.col("low").alias("id"), "t1", "t2").agg(F.collect_list(F.struct(
        "h", "c1", "c2", "low", "high", "first", "n")).alias("places"))
    distinct = scratch.save(rows.join(places, ["t1", "t2", "id"]).select("text", "places").mapInArrow(
        _cut(window), "h long, c1 long, c2 long, low long, high long, words binary"), "words")
    # an automaton of one stretch would give it back whole
    alone = once.join(groups, "h", "left_anti").select("c1", "c2", F.array(F.struct(
        F.lit(0).alias("a"), F.col("n").alias("b"), F.col("low"))).cast(RUNS).alias("runs"))
    runs = _judged(distinct, window, scratch).unionByName(alone)

    holders = several.select("t1", "t2", "first", "c1", "c2").distinct()
    spans = scratch.save(holders.join(runs, ["c1", "c2"]).groupBy("t1", "t2").agg(
        F.collect_set(F.struct("first", "runs")).alias("found")), "spans")

    def make():
        def work(pairs: list) -> dict:
            out = {c: [] for c in SCHEMA.names}
            for p in pairs:
                words = p["text"].encode().split()
                spans = [(f["first"] + r["a"], f["first"] + r["b"] + window - 1) for f in p["found"] or []
                         for r in f["runs"] if r["low"] < p["id"]]
                gone = _cover(len(words) if spans else 0, spans)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                out["kept"].append(b" ".join(compress(words, (~gone).tolist()) if spans else words).decode())
                out["repeats"].append(bool(p["found"]))
            return out
        return work

    own = [c for c in docs.columns if c not in SCHEMA.names and (keep is None or c in keep)]
    joined = (docs.select(F.struct(*own).alias("_own"), text.alias("_text"), id_.alias("_id"), *digest_columns(text))
              .join(spans, ["t1", "t2"], "left")
              .select("_own", F.struct(F.col("_text").alias("text"), F.col("_id").alias("id"), "found").alias("_pair"))
              .select("_own.*", "_pair"))
    return add_columns(joined, SCHEMA, make, "_pair", own, 64)
