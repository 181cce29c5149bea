"""Matching statistics and heads against a base of any length.

No index is broadcast: the suffixes of documents and base are ranked together, and each
document suffix takes the nearest base suffix below and above it, which is an as-of join
in both directions over slices of the ranks.  The ranks of the rounds tell how many
symbols it shares with either.  Long documents go by blocks of positions; their heads are
numbered by two-level running counts, so no task needs a whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.symbols import Alphabet
from ..session import Scratch, large
from .base_index import BASE_DOC, BaseString, base_suffixes
from .common_prefix import History, common_prefix
from .heads import ordered_index
from .pieces import started
from .ranking import rank_sequences
from .slices import with_nearest, with_neighbours
from .suffixes import PACKED_LONGS, suffix_rows, symbol_counts

POSITIONS = 1 << 16  # positions of a document in one window


@dataclass
class JointMatches:
    """``positions (doc, off, pos, len, smaller, is_head, sym)`` and ``ends (doc, off, sym)``, the places of the separators."""

    positions: DataFrame
    ends: DataFrame


def joint_matches(collection: DataFrame, base: BaseString, scratch: Scratch) -> JointMatches:
    """The matching statistics of ``collection``, whole or in pieces, whose keys are above ``BASE_DOC``."""
    counts = symbol_counts(started(collection).unionByName(
        base.blocks.select(F.col("block").alias("start"), "text"))).collect()  # one row per distinct symbol
    alphabet = Alphabet(tuple(sorted(r.code for r in counts if r.code >= 0)))
    rows = sum(r.n for r in counts)
    elements = suffix_rows(collection, alphabet).unionByName(base_suffixes(base, alphabet)).withColumn(
        "ends", F.col("k1") == 0)
    history = History(elements.select("doc", "off", "k1", "k2"), alphabet)
    ranked = scratch.save(rank_sequences(elements, ["k1", "k2", "tie"], PACKED_LONGS * alphabet.per_long, scratch, rows,
                                         ["sym", "ends"], history.rounds), "joint-ranks")
    near = scratch.save(with_nearest(ranked, "rank", ranked.count(), F.col("doc") == BASE_DOC, "off").filter(
        F.col("doc") != BASE_DOC).select("doc", "off", "sym", "ends", "below", "above"), "nearest")
    place = [F.col("doc").alias("a_doc"), F.col("off").alias("a_off"), F.lit(BASE_DOC).alias("b_doc")]
    inner = near.filter("not ends")
    pairs = inner.select(*place, F.col("below").alias("b_off"), F.lit(False).alias("upper"), "sym").unionByName(
        inner.select(*place, F.col("above").alias("b_off"), F.lit(True).alias("upper"), "sym"))
    shared = common_prefix(pairs, history, scratch)

    def side(column: str, upper: bool):
        return F.max(F.when(F.col("upper") == upper, F.col(column)))

    both = shared.groupBy(F.col("a_doc").alias("doc"), F.col("a_off").alias("off")).agg(
        F.max("sym").alias("sym"), side("n", False).alias("n_below"), side("n", True).alias("n_above"),
        side("b_off", False).alias("below"), side("b_off", True).alias("above"))
    smaller = F.coalesce(F.col("n_above") >= F.col("n_below"), F.lit(False))
    matched = both.select("doc", "off", "sym", F.when(smaller, F.col("above")).otherwise(F.col("below")).alias("pos"),
                          F.when(smaller, F.col("n_above")).otherwise(F.col("n_below")).alias("len"), smaller.alias("smaller"))
    return JointMatches(scratch.save(_with_head_marks(matched), "matches"), near.filter("ends").select("doc", "off", "sym"))


def _with_head_marks(matched: DataFrame) -> DataFrame:
    """Add ``is_head``: the match does not just continue the one before."""
    block = F.expr(f"off div {POSITIONS}")
    dealt = matched.withColumns({"own_block": block, "block": F.explode(F.array_compact(F.array(
        block, F.when(F.col("off") % POSITIONS == POSITIONS - 1, block + 1))))})
    before = F.lag("pos").over(Window.partitionBy("doc", "block").orderBy("off"))
    return (dealt.withColumn("is_head", F.coalesce(F.col("pos") != before + 1, F.lit(True)))
            .filter("block = own_block").drop("block", "own_block"))


def joint_heads(matches: JointMatches, base: BaseString, index: DataFrame, scratch: Scratch) -> DataFrame:
    """The heads with a separator head per document, as ``matching.insert_heads`` gives them."""
    zero = F.lit(0).cast("long")
    inner = matches.positions.filter("is_head").select(
        "doc", F.col("off").alias("start"), "pos", "len", "smaller", "sym", F.lit(False).alias("is_end"))
    ends = matches.ends.select("doc", F.col("off").alias("start"), F.lit(base.n - 1).cast("long").alias("pos"), zero.alias("len"),
                               F.lit(False).alias("smaller"), "sym", F.lit(True).alias("is_end"))
    both = scratch.save(inner.unionByName(ends), "heads-and-ends")
    rows = both.count()
    numbered = ordered_index(both, ["doc", "start"], "place", scratch, rows)
    linked = with_neighbours(numbered, "place", rows, after={"next_start": "start"})
    docs = scratch.save(numbered.groupBy("doc").agg(F.min("place").alias("first"), F.max("place").alias("last")), "first-heads")
    known = scratch.save(linked.join(large(docs), "doc").select(
        "doc", (F.col("place") - F.col("first")).alias("off"), (F.col("last") - F.col("first")).alias("end_off"), "start", "pos",
        "len", "smaller", "sym", F.when(F.col("is_end"), 0).otherwise(F.col("next_start") - F.col("start") - 1).alias("run_len"),
        (F.col("start") + F.col("len")).alias("reach")), "numbered-heads")
    # reaches never fall inside a document: the successor is the head after the last one with the same reach
    after = known.groupBy("doc", "reach").agg(F.max("off").alias("same_to"))
    succ = known.join(large(after), ["doc", "reach"]).withColumn("next_off", F.least(F.col("same_to") + 1, F.col("end_off")))
    to = known.select("doc", F.col("off").alias("next_off"), F.col("start").alias("to_start"), F.col("pos").alias("to_pos"))
    found = succ.join(large(to), ["doc", "next_off"]).withColumn("target", F.col("to_pos") + F.col("reach") - F.col("to_start"))
    # separators, one a document, all stand at one place, whose rank is 0; they are not looked up
    isa = index.select(F.col("pos").alias("at"), "isa")
    last = F.lit(base.n - 1).cast("long")

    def ranked(df: DataFrame, at: str, name: str) -> DataFrame:
        key = F.when(F.col(at) != last, F.col(at))
        return (df.withColumn("key", key).join(large(isa), F.col("key") == F.col("at"), "left")
                .withColumn(name, F.coalesce("isa", zero)).drop("key", "at", "isa"))

    return ranked(ranked(found, "pos", "isa_pos"), "target", "isa_next").select(
        "doc", "off", "start", "pos", "len", "smaller", "run_len", "sym", "next_off", "isa_pos", "isa_next")
