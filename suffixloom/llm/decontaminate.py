"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (small letters, ASCII punctuation
as white space).  Documents are joined with the items on the hashes of ``min_match``
words they share; for each pair whose shared words could cover enough of the item, the
matches of unmarked words are found at all their places by Karp-Rabin hashes of falling
window lengths, and the longest is marked in both, again and again, until none of
``min_match`` words is left.  The part of the
item's words under tiles is its coverage, whatever the order of the passages.

Scale: the items are the query set.  They are taken in blocks of ``BLOCK_WORDS`` words;
a block's seeds are broadcast, their size is bounded by that parameter, and every block
is one row-wise pass over all documents.  No document is exchanged, so frequent passages
and groups of copies cost each document its own pairs only.

Defined cases: null, empty or wordless texts and items match nothing; an item of fewer
than ``min_match`` words must be found whole; a repeated row is judged again, repeated
items are reported each; further columns pass through, those named as an added column
give way.
"""

from __future__ import annotations

import string
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import add_columns
from .rolling import BASE, INVERSE, powers, shingle_hashes, word_hashes

#: Pairs of windows of an item and a document that are followed at once.
PAIRS = 1 << 20
MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_WORDS = 2_000_000
PUNCTUATION = bytes(32 if chr(b) in string.punctuation else b for b in range(256))
SCHEMA = T.StructType([
    T.StructField("contaminated", T.BooleanType()), T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("best_coverage", T.DoubleType())])


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the normalised texts, and their numbers."""
    return word_hashes([(t or "").lower().encode().translate(PUNCTUATION) for t in texts])


def _unmarked_hashes(words: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows without marked words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    taken = np.append(0, np.cumsum(marked))
    at = np.flatnonzero(taken[size:] == taken[:n])
    return at, ((sums[size:] - sums[:n]) * powers(INVERSE, n))[at]


def _matches(doc: np.ndarray, item: np.ndarray, doc_marked: np.ndarray, item_marked: np.ndarray, size: int):
    """All longest runs of at least ``size`` unmarked words that agree: (words, place in ``item``, place in ``doc``).

    Windows of the item meet every place in the document with their hash; of the windows
    along a run only the first is taken, and followed word by word, all runs at once."""
    at_doc, in_doc = _unmarked_hashes(doc, doc_marked, size)
    at_item, in_item = _unmarked_hashes(item, item_marked, size)
    order = np.argsort(in_doc, kind="stable")
    low = np.searchsorted(in_doc[order], in_item)
    times = np.searchsorted(in_doc[order], in_item, side="right") - low
    found = []
    chunk = np.cumsum(times) // PAIRS
    for own in np.split(np.flatnonzero(times), np.flatnonzero(np.diff(chunk[times > 0])) + 1):
        n = times[own]
        i = np.repeat(at_item[own], n)
        d = at_doc[order[np.arange(n.sum()) + np.repeat(low[own] - (np.cumsum(n) - n), n)]]
        inside = (i > 0) & (d > 0)
        goes_back = inside & (doc[d - 1] == item[i - 1]) & ~doc_marked[d - 1] & ~item_marked[i - 1]
        i, d = i[~goes_back], d[~goes_back]
        length, active = np.full(len(i), size), np.arange(len(i))
        while len(active):
            x, y = i[active] + length[active], d[active] + length[active]
            more = (x < len(item)) & (y < len(doc))
            active, x, y = active[more], x[more], y[more]
            same = (doc[y] == item[x]) & ~doc_marked[y] & ~item_marked[x]
            active = active[same]
            length[active] += 1
        found.append((length, i, d))
    return [np.concatenate(c).tolist() for c in zip(*found)] if found else [[], [], []]


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """The tiles (place in ``doc``, place in ``item``, words) of two word sequences: again and again the
    longest match of unmarked words is marked, of equal ones the first in the item, then in the document."""
    doc_marked, item_marked = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    tiles, size = [], min(len(doc), len(item))
    while size >= min_match:
        queue = [(-n, i, d) for n, i, d in zip(*_matches(doc, item, doc_marked, item_marked, size))]
        heapify(queue)
        while queue:
            n, i, d = heappop(queue)
            taken = doc_marked[d:d - n] | item_marked[i:i - n]
            if not taken.any():
                doc_marked[d:d - n] = True
                item_marked[i:i - n] = True
                tiles.append((d, i, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8))).tolist()
            for a, b in zip(edges[0::2], edges[1::2]):  # what is left of it
                if b - a >= size:
                    heappush(queue, (a - b, i + a, d + a))
        size = max(min_match, size // 2) if size > min_match else 0
    return tiles


class Items:
    """The seeds of a block of items: hashes in order, with the items and places they stem from."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.ids = [r[0] for r in rows]
        words, counts = words_of([r[1] for r in rows])
        ends = np.cumsum(counts)
        self.words = [words[e - n:e] for e, n in zip(ends, counts)]
        self.needs = np.minimum(counts, min_match)
        self.seeds = {}
        for size in sorted(set(self.needs.tolist()) - {0}):
            own = [i for i in range(len(rows)) if self.needs[i] == size]
            hashes = [shingle_hashes(self.words[i], size) for i in own]
            owner = np.repeat(own, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.seeds[size] = flat[order], owner[order], place[order]

    def candidates(self, words: np.ndarray, doc_of: np.ndarray):
        """(document, item) pairs that share a seed, with the number of the item's words
        that shared seeds cover."""
        pairs, places, sizes = [], [], []
        n_items = len(self.ids)
        for size, (seeds, owner, place) in self.seeds.items():
            hashes = shingle_hashes(words, size)
            lo = np.searchsorted(seeds, hashes)
            lo[lo == len(seeds)] = 0
            hit = np.flatnonzero((seeds[lo] == hashes) & (doc_of[:len(hashes)] == doc_of[size - 1:]))
            first = lo[hit]
            times = np.searchsorted(seeds, hashes[hit], side="right") - first
            flat = np.repeat(first - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
            pairs.append(np.repeat(doc_of[hit], times) * n_items + owner[flat])
            places.append(place[flat])
            sizes.append(np.full(len(flat), size))
        if not pairs:
            return []
        pair, at, size = np.concatenate(pairs), np.concatenate(places), np.concatenate(sizes)
        order = np.lexsort((at, pair))
        pair, at, size = pair[order], at[order], size[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        step = np.append(at[1:] - at[:-1], 0)
        step[np.append(new[1:], True)] = np.iinfo(np.int64).max
        starts = np.flatnonzero(new)
        covered = np.add.reduceat(np.minimum(step, size), starts) if len(starts) else []
        return [(int(p) // n_items, int(p) % n_items, int(c)) for p, c in zip(pair[starts], covered)]


def _pass(docs: DataFrame, items, min_match: int, coverage: float, keep) -> DataFrame:
    """One pass over the documents with one block; results of earlier blocks are added to."""
    earlier = "item_ids" in docs.columns

    def make():
        block: Items = items.value

        def work(rows: list) -> dict:
            texts = [r["text"] for r in rows] if earlier else rows
            found = [list(r["item_ids"]) if earlier else [] for r in rows]
            best = [r["best_coverage"] if earlier else 0.0 for r in rows]
            words, counts = words_of(texts)
            ends = np.cumsum(counts)
            for d, i, bound in block.candidates(words, np.repeat(np.arange(len(texts)), counts)):
                item = block.words[i]
                if bound < coverage * len(item):
                    continue
                tiles = tile(words[ends[d] - counts[d]:ends[d]], item, int(block.needs[i]))
                share = sum(t[2] for t in tiles) / len(item)
                best[d] = max(best[d], share)
                if share >= coverage:
                    found[d].append(block.ids[i])
            return {"contaminated": [bool(f) for f in found], "item_ids": [sorted(f) for f in found],
                    "best_coverage": best}
        return work

    if earlier:
        own = [c for c in docs.columns if c not in SCHEMA.names]
        docs = docs.select(*own, F.struct("text", "item_ids", "best_coverage").alias("_row"))
        return add_columns(docs, SCHEMA, make, "_row", [c for c in own])
    return add_columns(docs, SCHEMA, make, "text", keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                  block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, if given) with ``contaminated``, ``item_ids`` (the
    items of which at least ``coverage`` is found) and ``best_coverage`` (over the items
    that could reach it)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # words at most
    blocks = max(1, int(-(-total // block_words)))
    own = [c for c in docs.columns if c not in SCHEMA.names]
    out = docs.select(*own)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text) for r in part.collect()]  # a block of the query set
        last = b == blocks - 1
        out = _pass(out, spark.sparkContext.broadcast(Items(rows, min_match)), min_match, coverage,
                    None if not last else keep)
    return out if keep is None else out.select(*keep, *SCHEMA.names)
