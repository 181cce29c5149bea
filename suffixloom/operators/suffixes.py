"""From documents to one row per suffix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.symbols import KEY_BITS, SEPARATOR, Alphabet, PrefixCode, codes_of, pack_windows, pack_words
from . import pieces as pc
from .pieces import in_pieces, key_columns, reblocked, started

CHUNK_SYMBOLS = 1 << 20  # texts are taken in pieces of about this size
CODED_SYMBOLS = 1 << 17  # and in smaller ones where each symbol has a row, as each takes about 150 bytes of a worker
PACKED_LONGS = 2
SUFFIX_SCHEMA = "doc long, off long, sym int, k1 long, k2 long, tie long"


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_SYMBOLS) -> Iterator[tuple[np.ndarray, list]]:
    """Group rows of a number and a text into pieces of bounded text."""
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(doc)
            texts.append(text)
            size += len(text) + 1
            if size >= most:
                yield np.array(docs, dtype=np.int64), texts
                docs, texts, size = [], [], 0
    if docs:
        yield np.array(docs, dtype=np.int64), texts


def require_unique_keys(collection: DataFrame) -> None:
    """Refuse a collection in which two documents, or two pieces of one, have one key."""
    twice = collection.groupBy(*key_columns(collection)).agg(F.count("*").alias("n")).filter("n > 1").select("doc").head(1)
    if twice:
        raise ValueError(f"several documents have the key {twice[0].doc}")


def symbol_counts(collection: DataFrame) -> DataFrame:
    """``(code, n)``: how often each symbol occurs; code -1 counts the documents."""

    def count(batches):
        for starts, texts in chunks(batches):
            codes, n = np.unique(codes_of(texts), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "code": np.append(codes.astype(np.int64), -1), "n": np.append(n, np.count_nonzero(starts == 0)).astype(np.int64)})

    return (started(collection).mapInArrow(count, "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n")))


def suffix_rows(collection: DataFrame, alphabet: Alphabet) -> DataFrame:
    """One row per suffix, the empty one included: its first symbols packed into
    ``k1, k2``, the symbol before it, and the tie-break of suffixes that end
    within the packed symbols (document order)."""
    if in_pieces(collection):
        return piece_suffix_rows(collection, alphabet, pc.PIECE)

    def explode(batches):
        table, width = alphabet.table(), PACKED_LONGS * alphabet.per_long

        def rows(codes, before, doc, off):
            """Rows of the positions of ``doc, off``; ``codes`` holds more symbols than positions."""
            (k1, k2), ended = pack_windows(codes, len(doc), alphabet, PACKED_LONGS)
            yield from pa.Table.from_pydict({
                "doc": doc, "off": off, "sym": before, "k1": k1, "k2": k2,
                "tie": np.where(ended, doc + 1, 0)}).to_batches(max_chunksize=1 << 16)

        for docs, texts in chunks(batches):
            long_docs = [i for i, t in enumerate(texts) if len(t) > CHUNK_SYMBOLS]
            for i in long_docs:  # a long text goes by slices that overlap by what is packed
                text = texts[i]
                for lo in range(0, len(text) + 1, CHUNK_SYMBOLS):
                    n = min(CHUNK_SYMBOLS, len(text) + 1 - lo)
                    codes = np.zeros(n + width, dtype=np.int64)
                    piece = codes_of([text[lo:lo + n + width]])
                    codes[:len(piece)] = table[piece]
                    prev = codes_of([text[max(lo - 1, 0):lo + n - 1]]).astype(np.int32)
                    before = prev if lo else np.append(np.int32(SEPARATOR), prev)
                    yield from rows(codes, before, np.full(n, docs[i]), np.arange(lo, lo + n))
            if long_docs:
                short = [i for i, t in enumerate(texts) if len(t) <= CHUNK_SYMBOLS]
                docs, texts = docs[short], [texts[i] for i in short]
            if not texts:
                continue
            codes = codes_of(texts)
            lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
            starts = np.cumsum(lens + 1) - (lens + 1)
            total = len(codes) + len(texts)
            dense = np.zeros(total + width, dtype=np.int64)
            before = np.full(total + 1, SEPARATOR, dtype=np.int32)
            at = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lens)
            dense[at] = table[codes]
            before[at + 1] = codes
            before[starts] = SEPARATOR
            yield from rows(dense, before[:-1], np.repeat(docs, lens + 1),
                            np.arange(total) - np.repeat(starts, lens + 1))

    return collection.select("doc", "text").mapInArrow(explode, SUFFIX_SCHEMA)


def coded_suffix_rows(collection: DataFrame, code: PrefixCode) -> DataFrame:
    """As ``suffix_rows``, of whole documents, whose first symbols are packed by a prefix code: ``k1, k2`` hold
    ``KEY_BITS`` bits of the suffix, at least ``code.depth`` symbols and more of those that are frequent."""

    def explode(batches):
        table = code.table()

        def rows(docs, codes, lens, before, lo, goes_on):
            """Rows of the first ``lens`` symbols and the end of each text, from offset ``lo`` on; ``goes_on``: of a
            single text, whose ``codes`` are more than its ``lens``."""
            n = lens + (not goes_on)
            starts = np.cumsum(n) - n
            total = int(n.sum())
            if goes_on:
                dense, end = table[codes], np.full(total, len(codes))
                at = np.arange(total)
            else:
                dense, at = np.zeros(total, dtype=np.int64), np.arange(total)
                dense[np.arange(len(codes)) + np.repeat(np.arange(len(n)), lens)] = table[codes]
                end = np.repeat(starts + lens, n)
            (k1, k2), ended = pack_words(dense, at, end, code)
            doc = np.repeat(docs, n)
            yield from pa.Table.from_pydict({
                "doc": doc, "off": lo + at - np.repeat(starts, n), "sym": before, "k1": k1, "k2": k2,
                "tie": np.where(ended, doc + 1, 0)}).to_batches(max_chunksize=1 << 16)

        for docs, texts in chunks(batches, CODED_SYMBOLS):
            for i in [i for i, t in enumerate(texts) if len(t) > CODED_SYMBOLS]:
                text = texts[i]  # a long text goes by slices that overlap by the symbols that the bits may need
                for lo in range(0, len(text) + 1, CODED_SYMBOLS):
                    piece = text[lo:lo + CODED_SYMBOLS + KEY_BITS]
                    goes_on = lo + len(piece) < len(text)
                    n = CODED_SYMBOLS if goes_on else len(piece)
                    prev = codes_of([text[max(lo - 1, 0):lo + n]]).astype(np.int32)
                    before = (prev if lo else np.append(np.int32(SEPARATOR), prev))[:n + (not goes_on)]
                    yield from rows(docs[i:i + 1], codes_of([piece]), np.array([n]), before, lo, goes_on)
                    if not goes_on:
                        break
            short = [i for i, t in enumerate(texts) if len(t) <= CODED_SYMBOLS]
            if not short:
                continue
            docs, texts = docs[short], [texts[i] for i in short]
            codes = codes_of(texts)
            lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
            before = np.full(len(codes) + len(texts) + 1, SEPARATOR, dtype=np.int32)
            before[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lens) + 1] = codes
            before[np.cumsum(lens + 1) - (lens + 1)] = SEPARATOR
            yield from rows(docs, codes, lens, before[:-1], 0, False)

    return collection.select("doc", "text").mapInArrow(explode, SUFFIX_SCHEMA)


def piece_suffix_rows(pieces: DataFrame, alphabet: Alphabet, size: int) -> DataFrame:
    """As ``suffix_rows``, of documents in pieces (``doc, start, text``), by blocks of ``size`` symbols with the
    symbol before and those that the packing needs; no task holds more of a document than a block."""
    width = PACKED_LONGS * alphabet.per_long

    def explode(batches):
        table = alphabet.table()
        for batch in batches:
            for doc, block, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                lo, own = block * size, len(text) - (block > 0)
                if own == 0 and block:
                    continue  # nothing but the lead: the document ends where the block would start
                rows = min(size, own) + (own <= size)  # the last block has the empty suffix
                codes = codes_of([text]).astype(np.int32)
                before = codes[:rows] if lo else np.append(np.int32(SEPARATOR), codes)[:rows]
                ahead = table[codes[1:] if lo else codes]
                dense = np.zeros(rows + width, dtype=np.int64)
                dense[:min(len(ahead), rows + width)] = ahead[:rows + width]
                (k1, k2), ended = pack_windows(dense, rows, alphabet, PACKED_LONGS)
                yield from pa.Table.from_pydict({
                    "doc": np.full(rows, doc), "off": lo + np.arange(rows), "sym": before, "k1": k1, "k2": k2,
                    "tie": np.where(ended, doc + 1, 0)}).to_batches(max_chunksize=1 << 16)

    return reblocked(pieces, size, width, empty=True).mapInArrow(explode, SUFFIX_SCHEMA)
