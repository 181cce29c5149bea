"""BWT of any collection: rank all suffixes, emit the symbol before each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.symbols import Alphabet, prefix_code, symbol_column
from ..operators.packed import PackedSuffixes, pack_suffixes
from ..operators.pieces import in_pieces, key_columns, relation
from ..operators.ranking import rank_sequences
from ..operators.runs import rl_bwt_columns, runs_of_ranks
from ..operators.suffixes import PACKED_LONGS, coded_suffix_rows, require_unique_keys, suffix_rows, symbol_counts
from ..session import Scratch, spread

PACKED_FROM = 1 << 18  # suffixes from which they are sorted as packed arrays; fewer are not worth the chunks


@dataclass
class RankedSuffixes:
    """All suffixes ``(doc, off, sym, rank)`` and how many there are."""

    suffixes: DataFrame
    rows: int
    scratch: Scratch

    def bwt(self) -> DataFrame:
        return self.suffixes.select(F.col("rank").alias("bwt_idx"), symbol_column(F.col("sym")).alias("ch"))

    def runs(self) -> DataFrame:
        return runs_of_ranks(self.suffixes, self.rows, self.scratch)

    def rl_bwt(self) -> DataFrame:
        return rl_bwt_columns(self.runs())

    def close(self) -> None:
        """Drop the tables behind the ranks."""
        self.scratch.delete()


def rank_suffixes(collection: DataFrame, scratch: Scratch | None = None) -> RankedSuffixes | PackedSuffixes:
    """Rank every suffix of ``collection (doc BIGINT, text)``, or of one in pieces; ``doc`` is unique
    and gives the document order.  Many suffixes of whole documents are sorted as packed arrays where a task
    can hold their documents and groups, all others row by row."""
    scratch = scratch or Scratch(collection.sparkSession)
    collection = spread(relation(collection), *key_columns(collection))
    require_unique_keys(collection)
    counts = symbol_counts(collection).collect()  # one row per distinct symbol
    rows = sum(r.n for r in counts)
    counted = {r.code: r.n for r in counts}
    if in_pieces(collection):
        alphabet = Alphabet(tuple(sorted(c for c in counted if c >= 0)))
        elements, depth = suffix_rows(collection, alphabet), PACKED_LONGS * alphabet.per_long
    else:
        code = prefix_code({c: n for c, n in counted.items() if c >= 0}, counted.get(-1, 0))
        packed = pack_suffixes(collection, code, rows, scratch) if rows >= PACKED_FROM else None
        if packed is not None:
            return packed
        elements, depth = coded_suffix_rows(collection, code), code.depth
    ranked = rank_sequences(elements, ["k1", "k2", "tie"], depth, scratch, rows, ["sym"])
    return RankedSuffixes(ranked, rows, scratch)
