"""One entry point that picks the plan; the result never depends on the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.base_index import base_symbols
from ..operators.matching import insert_heads
from ..operators.pieces import in_pieces
from ..session import broadcast_symbols
from ..sources.collections import prefix_limit
from .compressed import CompressedBwt
from .suffix_sort import rank_suffixes

SAMPLE_SHARE = 64  # one document of so many is matched to estimate the heads
WHOLE_BELOW = 4096  # with fewer documents all of them are
WORTH_IT = 0.1  # heads per position up to which ranking heads beats ranking suffixes


def choose(collection: DataFrame, base: DataFrame | None) -> CompressedBwt | None:
    """The heads plan, with its index built, if the base is short enough for a broadcast and the
    documents match it well: a share of them, picked by a hash of their key, tells.  With a longer
    base, or documents in pieces, the heads plan would rank all suffixes to find the heads, so ranking them is the plan."""
    if base is None or in_pieces(collection) or not 0 < base_symbols(base) <= broadcast_symbols(collection.sparkSession):
        return None
    plan = CompressedBwt(collection, base)
    share = SAMPLE_SHARE if collection.count() >= WHOLE_BELOW else 1
    sample = plan.collection.filter(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0)
    seen = insert_heads(sample, plan.arrays).agg(
        F.count("*").alias("heads"), F.sum(F.col("run_len") + 1).alias("positions")).first()
    if seen.heads and seen.heads <= WORTH_IT * seen.positions:
        return plan
    plan.close()
    return None


def bwt(collection: DataFrame, base: DataFrame | None = None, prefix: int | None = None, strategy: str | None = None):
    """Plan the BWT of ``collection (doc BIGINT, text)``, or of one in pieces ``(doc, start, text)``.

    ``base``: what the documents resemble, one ``text`` or ``block, text`` rows.  ``prefix``: use only the first
    so many symbols, separators counted.  ``strategy``: ``suffixes`` or ``heads``
    instead of the planner's choice.  The result has ``bwt()``, ``runs()`` and
    ``rl_bwt()``.
    """
    if prefix is not None:
        collection = prefix_limit(collection, prefix)
    if strategy == "heads":
        return CompressedBwt(collection, base)
    if strategy not in (None, "suffixes"):
        raise ValueError(f"unknown strategy {strategy}")
    return (choose(collection, base) if strategy is None else None) or rank_suffixes(collection)
