"""Documents in pieces, for texts that no single cell should hold.

A collection comes as ``doc, text`` rows or, in pieces, as ``doc, start, text`` rows: the
pieces of a document follow each other without gaps, ``start`` being the place of a
piece's first symbol, and an empty document is one empty piece.  Pieces may have any
length; operators cut them to blocks of their own size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

PIECE = 1 << 20  # symbols of a document in one row


def in_pieces(collection: DataFrame) -> bool:
    return "start" in collection.columns


def key_columns(collection: DataFrame) -> list[str]:
    """What tells the rows of a collection apart."""
    return ["doc", "start"] if in_pieces(collection) else ["doc"]


def relation(collection: DataFrame) -> DataFrame:
    """The columns of a collection, whole or in pieces."""
    return collection.select(*key_columns(collection), "text")


def started(collection: DataFrame) -> DataFrame:
    """``start, text`` of all rows; one row of each document starts at 0."""
    return collection.select(F.col("start") if in_pieces(collection) else F.lit(0).cast("long").alias("start"), "text")


def is_binary(df: DataFrame) -> bool:
    return isinstance(df.schema["text"].dataType, T.BinaryType)


def joined(pieces: Column, text: Column | str, binary: bool) -> Column:
    """The texts of an array of structs, one after the other."""
    if binary:
        return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p[text])), ""))
    return F.array_join(F.transform(pieces, lambda p: p[text]), "")


def _cut(size: int, halo: int, empty: bool):
    """Cut texts that start at ``start`` into what they add to each block of ``size`` symbols, which
    reaches from one symbol before it to ``halo`` symbols after it if there is a halo."""
    lead = 1 if halo else 0

    def run(batches):
        for batch in batches:
            rows, kind = [], batch.schema.field(2).type
            for doc, start, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if empty and not text:
                    rows.append((doc, 0, 0, text))
                first = max((start - halo) // size, 0)
                for block in range(first, (start + len(text) - 1 + lead) // size + 1):
                    lo, hi = max(block * size - lead, start), min((block + 1) * size + halo, start + len(text))
                    if lo < hi:
                        rows.append((doc, block, lo, text[lo - start:hi - start]))
                    if len(rows) >= 256:
                        yield _batch(rows, kind)
                        rows = []
            if rows:
                yield _batch(rows, kind)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    docs, blocks, places, texts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, kind)],
        names=["doc", "block", "at", "text"])


def reblocked(placed: DataFrame, size: int, halo: int = 0, empty: bool = False) -> DataFrame:
    """``doc, block, text`` of texts that come as ``doc, start, text`` rows; nothing else is exchanged.

    Block ``block`` holds the ``size`` symbols from ``block * size`` on.  With a halo it is led by the
    symbol before it and followed by ``halo`` symbols, so a block with nothing but that lead may
    follow the last one.  Whether empty texts give an empty first block, ``empty`` tells."""
    kind = placed.schema["text"].dataType.simpleString()
    cut = placed.select("doc", "start", "text").mapInArrow(
        _cut(size, halo, empty), f"doc long, block long, at long, text {kind}")
    return cut.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("p")).select(
        "doc", "block", joined(F.col("p"), "text", is_binary(placed)).alias("text"))
