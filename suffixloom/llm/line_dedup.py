"""Drop lines that many documents share.

Lines are exploded with their place, hashed by their normalised key and counted by
distinct documents; the places of lines over the threshold are gathered per text,
and the text is put together again from the other places in order.

A text stands for itself in joins by a 128-bit digest, so neither null nor repeated
document ids matter, and what copies have in common is gathered once.  Hot keys:
counts are combined before the exchange; the joins that bring hot lines back to
their texts, and the dropped places back to the documents, are joins of two plain
tables, which adaptive execution splits where one key is frequent.

Defined cases: a null or empty text is one empty line, which is never dropped; a
repeated row is a document of its own; further columns pass through unchanged, and
a column named as one that is added gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .common import ascii_lower, bound, digest_columns, strip

LINE_BREAK = "\n"


def _marked_lines(text: Column) -> Column:
    """For each line that has a key: the key's digest, its place, and whether the key
    appears there for the first time in the text."""
    keys = F.transform(F.transform(F.split(text, LINE_BREAK, -1), strip), ascii_lower)
    placed = F.filter(F.transform(keys, lambda k, i: F.struct(
        *digest_columns(k, "k1", "k2"), i.alias("pos"), (F.length(k) > 0).alias("has"))), lambda e: e["has"])

    def flag(rows):
        def one(e, i):
            before = F.get(rows, i - 1)
            same = (i > 0) & (before["k1"] == e["k1"]) & (before["k2"] == e["k2"])
            return F.struct(e["k1"].alias("k1"), e["k2"].alias("k2"), e["pos"].alias("pos"), (~same).alias("first"))
        return F.transform(rows, one)

    return bound(F.sort_array(placed), flag)


def line_dedup(docs: DataFrame, min_docs: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text left).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys
    found in at least ``min_docs`` documents lose all their lines in every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = scratch.save(
        docs.select(*digest_columns(text), F.explode(_marked_lines(text)).alias("l")).select("t1", "t2", "l.*"),
        "lines")
    shared = scratch.save(lines.filter("first").groupBy("k1", "k2").agg(F.count("*").alias("docs"))
                          .filter(F.col("docs") >= min_docs).select("k1", "k2"), "shared-keys")
    dropped = scratch.save(lines.join(shared, ["k1", "k2"], "left_semi").groupBy("t1", "t2")
                           .agg(F.collect_set("pos").alias("drop")), "dropped-places")
    added = ("n_lines", "n_dropped", "kept")
    own = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*own).alias("row"), text.alias("text"), *digest_columns(text))
    places = F.coalesce("drop", F.array().cast("array<int>"))
    parts = F.split("text", LINE_BREAK, -1)
    left = bound(parts, lambda p: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), places), lambda i: F.get(p, i)))
    out = rows.join(dropped, ["t1", "t2"], "left").select(
        "row", F.size(parts).cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_dropped"),
        F.when(F.size(places) == 0, F.col("text")).otherwise(F.array_join(left, LINE_BREAK)).alias("kept"))
    return out.select("row.*", *added)
