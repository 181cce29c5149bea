"""Matching statistics of documents against the base string.

For each position of a document: the base suffix ``pos`` that shares the longest
prefix (``len`` symbols) with the document's suffix - the next larger one if that
is among the longest (``smaller``), else the next smaller one.  Positions whose
match does not just continue the match before them are heads.

The document's suffix is placed among the sorted base suffixes from right to left:
its place follows from its first symbol and the place of the suffix after it.  The
base index is broadcast after a check of its size; documents are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.symbols import FIRST_CODE, SEPARATOR, PrefixCode, codes_of, pack_words
from .base_index import BaseString
from .suffixes import CHUNK_SYMBOLS, chunks

LOCKSTEP_DOCS = 16
CODED_SYMBOLS = 1 << 19  # texts are matched in pieces of about this size where the heads bring their first bits
MATCH_SCHEMA = "doc long, off long, pos long, len long, smaller boolean, is_head boolean"
HEAD_SCHEMA = ("doc long, off long, start long, pos long, len long, smaller boolean, run_len long, sym int, "
               "next_off long, isa_pos long, isa_next long")
TEXT_KEY = ["k1", "k2", "tie"]


def base_arrays(index: DataFrame, base: BaseString) -> SimpleNamespace:
    """The base index as arrays for the Python workers: ``codes`` (symbols, then -1),
    ``sa``, ``isa``, ``lcp`` (ended by -1) and ``steps``: the sorted values
    symbol * (n + 1) + rank of each suffix and the symbol before it."""
    rows = index.select("pos", "isa", "lcp").toArrow()  # n rows, n is bounded
    n = base.n
    pos, rank = rows["pos"].to_numpy(), rows["isa"].to_numpy()
    sa, isa = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    sa[rank], isa[pos] = pos, rank
    lcp = np.full(n + 1, -1, dtype=np.int64)
    lcp[rank] = rows["lcp"].to_numpy()
    codes = np.append(base.codes, -1)
    ranks = np.flatnonzero(sa > 0)
    steps = np.sort(codes[sa[ranks] - 1] * (n + 1) + ranks)
    size = np.int32 if n < 1 << 31 else np.int64
    return SimpleNamespace(codes=codes.astype(np.int32), sa=sa.astype(size), isa=isa.astype(size),
                           lcp=lcp.astype(size), steps=steps)


def _places(text: np.ndarray, ends: np.ndarray, lens: np.ndarray, base: SimpleNamespace) -> np.ndarray:
    """Number of base suffixes below each suffix of the texts, which end at ``ends``.

    The documents of a batch advance together, as long as enough of them are left.
    """
    width = len(base.sa) + 1
    out = np.full(len(text), 2, dtype=np.int64)  # only the two end suffixes of the base precede a separator
    order = np.argsort(-lens)
    at, by_len, place = ends[order].copy(), lens[order], np.full(len(lens), 2, dtype=np.int64)
    step, live = 0, len(order)
    while True:
        while live and by_len[live - 1] <= step:
            live -= 1
        if live < LOCKSTEP_DOCS:
            break
        at[:live] -= 1
        place[:live] = np.searchsorted(base.steps, text[at[:live]] * width + place[:live]) + 1
        out[at[:live]] = place[:live]
        step += 1
    if live:
        steps = base.steps.tolist()
        for d in range(live):
            here, i = int(place[d]), int(at[d])
            syms = (text[i - (by_len[d] - step):i] * width).tolist()
            found = []
            for sym in reversed(syms):
                here = bisect_left(steps, sym + here) + 1
                found.append(here)
            out[i - len(found):i] = found[::-1]
    return out


def _match(docs: np.ndarray, texts: list, base: SimpleNamespace):
    """Match a batch of documents, laid out one after the other with separators."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    text = np.full(ends[-1] + 1, SEPARATOR, dtype=np.int64)
    raw = codes_of(texts).astype(np.int64) + FIRST_CODE
    text[np.arange(len(raw)) + np.repeat(np.arange(len(texts)), lens)] = raw
    n = len(base.sa)
    place = _places(text, ends, lens, base)
    above = base.sa[np.minimum(place, n - 1)].astype(np.int64)
    below = base.sa[place - 1].astype(np.int64)
    at = np.arange(len(text))
    shared = np.maximum(base.lcp[place], 0).astype(np.int64)  # what both neighbours share with the suffix
    symbol = text[np.minimum(at + shared, len(text) - 1)]
    no_above = place == n
    longer_above = ~no_above & (base.codes[above + shared] == symbol)
    longer_below = base.codes[below + shared] == symbol
    smaller = ~(longer_below | no_above)
    pos = np.where(smaller, above, below)
    is_sep = np.zeros(len(text), dtype=bool)
    is_sep[ends] = True
    pos[ends], smaller[ends], shared[ends] = n - 1, False, 0
    head = np.append(True, pos[1:] != pos[:-1] + 1)
    head[starts] = True
    head[ends] = True
    heads = np.flatnonzero(head)
    length = shared[heads]
    grow = np.flatnonzero((longer_above | longer_below)[heads] & ~is_sep[heads])
    while len(grow):
        i = heads[grow]
        same = text[i + length[grow]] == base.codes[pos[i] + length[grow]]
        grow = grow[same]
        length[grow] += 1
    doc_of = np.repeat(np.arange(len(docs)), lens + 1)
    return text, at, pos, smaller, head, heads, length, doc_of, starts, ends, is_sep


def _tables(columns: dict):
    yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=1 << 16)


def matching_statistics(collection: DataFrame, arrays) -> DataFrame:
    """One row per document position (separators excluded); ``arrays`` is the
    broadcast :func:`base_arrays`."""

    def run(batches):
        for docs, texts in chunks(batches):
            text, at, pos, smaller, head, heads, length, doc_of, starts, _, is_sep = _match(docs, texts, arrays.value)
            lead = np.maximum.accumulate(np.where(head, at, 0))
            full = np.zeros(len(text), dtype=np.int64)
            full[heads] = length
            keep = ~is_sep
            yield from _tables({
                "doc": docs[doc_of][keep], "off": (at - starts[doc_of])[keep], "pos": pos[keep],
                "len": (full[lead] - (at - lead))[keep], "smaller": smaller[lead][keep], "is_head": head[keep]})

    return collection.select("doc", "text").mapInArrow(run, MATCH_SCHEMA)


def insert_heads(collection: DataFrame, arrays, code: PrefixCode | None = None) -> DataFrame:
    """The heads only, with a separator head per document.

    ``off`` numbers the heads of a document, ``next_off`` is the first later head
    whose match reaches further (a separator's is itself), ``run_len`` counts the
    positions up to the next head and ``sym`` is the symbol before the head.  With a ``code``, ``k1, k2`` are the
    first bits of the text from the head on and ``tie`` tells apart those that end within them."""

    def text_key(text, heads, end, is_sep, docs):
        dense = np.zeros(len(text), dtype=np.int64)
        dense[~is_sep] = code.table()[text[~is_sep] - FIRST_CODE]
        (k1, k2), ended = pack_words(dense, heads, end, code)
        return dict(zip(TEXT_KEY, (k1, k2, np.where(ended, docs + 1, 0))))

    def run(batches):
        for docs, texts in chunks(batches, CODED_SYMBOLS if code else CHUNK_SYMBOLS):
            base = arrays.value
            text, _, pos, smaller, _, heads, length, doc_of, starts, ends, is_sep = _match(docs, texts, base)
            doc = doc_of[heads]
            reach = heads + length
            sep_at = np.flatnonzero(is_sep[heads])
            nxt = np.minimum(np.searchsorted(reach, reach, side="right"), sep_at[doc])
            target = pos[heads[nxt]] + reach - heads[nxt]
            first = np.append(0, sep_at[:-1] + 1)
            before = np.where(heads == starts[doc], SEPARATOR, text[heads - 1] - FIRST_CODE)
            yield from _tables({
                "doc": docs[doc], "off": np.arange(len(heads)) - first[doc], "start": heads - starts[doc],
                "pos": pos[heads], "len": length, "smaller": smaller[heads],
                "run_len": np.where(is_sep[heads], 0, np.append(heads[1:], 0) - heads - 1),
                "sym": before.astype(np.int32), "next_off": nxt - first[doc],
                "isa_pos": base.isa[pos[heads]].astype(np.int64), "isa_next": base.isa[target].astype(np.int64)}
                | (text_key(text, heads, ends[doc], is_sep, docs[doc]) if code else {}))

    schema = HEAD_SCHEMA + "".join(f", {c} long" for c in TEXT_KEY) if code else HEAD_SCHEMA
    return collection.select("doc", "text").mapInArrow(run, schema)


def head_key() -> list[Column]:
    """Order of heads in one bucket of ``isa_pos``: those below the base suffix
    first; there an early mismatch is smaller, above it larger."""
    return [(~F.col("smaller")).cast("long").alias("above"),
            F.when(F.col("smaller"), F.col("len")).otherwise(-F.col("len")).alias("reach")]
