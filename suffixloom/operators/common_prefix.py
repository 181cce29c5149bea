"""Common prefixes of pairs of suffixes, from the ranks of the rounds that sorted them.

After each round of the sort two suffixes share their rank exactly if they agree in the
symbols covered so far.  The table of a round holds the suffixes that still shared
theirs, so tables shrink from round to round.  A pair first climbs the rounds as long as
its ranks agree, then descends them: where the ranks of the places reached agree, both
move on by what the round covers.  The packed first symbols tell the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.symbols import Alphabet
from ..session import Scratch, large
from .ranking import STEPS

PAIR = ["a_doc", "a_off", "b_doc", "b_off"]


@dataclass
class History:
    """``rounds``: (symbols covered, ``doc, off, rk`` of the suffixes that share their rank);
    ``keys (doc, off, k1, k2)``: the packed first symbols of all suffixes."""

    keys: DataFrame
    alphabet: Alphabet
    rounds: list[tuple[int, DataFrame]] = field(default_factory=list)


def _same_rank(pairs: DataFrame, ranks: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: whether both places ``n`` symbols into the pair share a rank."""
    a = ranks.select(F.col("doc").alias("a_doc"), F.col("off").alias("a_at"), F.col("rk").alias("a_rk"))
    b = ranks.select(F.col("doc").alias("b_doc"), F.col("off").alias("b_at"), F.col("rk").alias("b_rk"))
    found = (pairs.withColumns({"a_at": F.col("a_off") + F.col("n"), "b_at": F.col("b_off") + F.col("n")})
             .join(large(a), ["a_doc", "a_at"], "left").join(large(b), ["b_doc", "b_at"], "left"))
    return found.withColumn(flag, F.coalesce(F.col("a_rk") == F.col("b_rk"), F.lit(False))).drop("a_at", "b_at", "a_rk", "b_rk")


def _bits(x: Column) -> Column:
    return F.length(F.bin(x))


def _agreeing(x: Column, y: Column, alphabet: Alphabet) -> Column:
    """How many leading symbols of two packed columns agree; what follows the end of a text counts as none."""
    symbols = F.when(x == 0, 0).otherwise(
        alphabet.per_long - F.floor((_bits(x.bitwiseAND(-x)) - 1) / alphabet.bits))
    same = F.floor((alphabet.per_long * alphabet.bits - _bits(x.bitwiseXOR(y))) / alphabet.bits)
    return F.when(x == y, symbols).otherwise(same).cast("long")


def common_prefix(pairs: DataFrame, history: History, scratch: Scratch) -> DataFrame:
    """Add ``n``, the number of leading symbols on which two different suffixes agree, to ``pairs
    (a_doc, a_off, b_doc, b_off, ..)``.  A pair whose ``b_off`` is null is left out."""
    rest = pairs.filter("b_off is not null").withColumn("n", F.lit(0).cast("long"))
    deepest: list[DataFrame] = []  # by round: the pairs that agree in it but not in the next
    plain = None
    for depth, ranks in history.rounds:
        judged = scratch.save(_same_rank(rest, ranks, "same"), "pairs")
        part = judged.filter("not same").drop("same")
        if plain is None:
            plain = part
        else:
            deepest.append(part)
        rest = judged.filter("same").drop("same")
    if plain is None:
        plain = rest
    else:
        deepest.append(rest)
    active = None
    for (depth, ranks), own in reversed(list(zip(history.rounds, deepest))):
        entering = own.withColumn("n", F.lit(depth).cast("long"))
        active = entering if active is None else active.unionByName(entering)
        for _ in range(STEPS):
            active = _same_rank(active, ranks, "more").withColumn(
                "n", F.col("n") + F.when(F.col("more"), depth).otherwise(0)).drop("more")
        active = scratch.save(active, "pairs")
    every = plain if active is None else plain.unionByName(active)
    keys = history.keys
    a = keys.select(F.col("doc").alias("a_doc"), F.col("off").alias("a_at"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = keys.select(F.col("doc").alias("b_doc"), F.col("off").alias("b_at"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    last = (every.withColumns({"a_at": F.col("a_off") + F.col("n"), "b_at": F.col("b_off") + F.col("n")})
            .join(large(a), ["a_doc", "a_at"]).join(large(b), ["b_doc", "b_at"]))
    one = _agreeing(F.col("a1"), F.col("b1"), history.alphabet)
    two = _agreeing(F.col("a2"), F.col("b2"), history.alphabet)
    more = one + F.when(F.col("a1") == F.col("b1"), two).otherwise(0)  # after an end there are no symbols
    return last.withColumn("n", (F.col("n") + more).cast("long")).drop("a_at", "b_at", "a1", "a2", "b1", "b2")
