"""BWT of a collection whose documents resemble a base string: only the heads of
the matching statistics are ranked, everything between them is counted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.symbols import prefix_code
from ..operators import base_index as bi, buckets as bk, heads as hd, joint_matching as jm, matching as mt
from ..operators.pieces import in_pieces, key_columns, relation
from ..operators.suffixes import require_unique_keys, symbol_counts
from ..operators.runs import expand_runs, rl_bwt_columns, runs_of
from ..session import Scratch, broadcast_symbols, free_shuffles, spread

LINK_PASSES = 2


@dataclass
class CompressedBwt:
    """The relations between a collection, whole or in pieces, and a base, one ``text`` or ``block, text``
    rows, each computed when first used.

    Documents are matched in place against a broadcast index where they come whole and the base is short
    enough for one, else by ranking their suffixes together with the base's; the relations are the same."""

    collection: DataFrame
    base_row: DataFrame
    #: Whether to match against a broadcast index; by the base's length if not given.
    broadcast: bool | None = None

    def __post_init__(self):
        self.spark = self.collection.sparkSession
        self.scratch = Scratch(self.spark)
        self.collection = spread(relation(self.collection), *key_columns(self.collection))
        require_unique_keys(self.collection)

    @cached_property
    def base(self) -> bi.BaseString:
        return bi.augment(self.base_row, self.collection, self.scratch)

    @property
    def broadcasts(self) -> bool:
        """Whether documents are matched against a broadcast index; the base must be short enough for it
        and the documents whole."""
        fits = self.base.symbols <= broadcast_symbols(self.spark)
        return fits and self.broadcast is not False and not in_pieces(self.collection)

    @cached_property
    def index(self) -> DataFrame:
        return bi.base_index(self.spark, self.base, self.scratch)

    @cached_property
    def arrays(self):
        return self.spark.sparkContext.broadcast(mt.base_arrays(self.index, self.base))

    @cached_property
    def joint(self) -> jm.JointMatches:
        return jm.joint_matches(self.collection, self.base, self.scratch)

    @cached_property
    def matches(self) -> DataFrame:
        if self.broadcasts:
            return mt.matching_statistics(self.collection, self.arrays)
        return self.joint.positions.select("doc", "off", "pos", "len", "smaller", "is_head")

    @cached_property
    def _ranking(self) -> Scratch:
        """The tables that only the ranking of the heads reads."""
        return Scratch(self.spark)

    @cached_property
    def _keyed_heads(self) -> DataFrame:
        """The heads; if matched in place, with the first bits of their texts.  Read until they are ranked."""
        if not self.broadcasts:
            return self.scratch.save(jm.joint_heads(self.joint, self.base, self.index, self.scratch), "heads")
        counts = {r.code: r.n for r in symbol_counts(self.collection).collect()}  # one row per distinct symbol
        code = prefix_code({c: n for c, n in counts.items() if c >= 0}, counts.get(-1, 0))
        return self._ranking.save(mt.insert_heads(self.collection, self.arrays, code), "keyed-heads")

    @cached_property
    def heads(self) -> DataFrame:
        keyed = self._keyed_heads
        return self.scratch.save(keyed.drop(*mt.TEXT_KEY), "heads") if self.broadcasts else keyed

    @cached_property
    def n_heads(self) -> int:
        return self._keyed_heads.count()

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        """The table of rows that the heads give, without the shuffle files behind them."""
        saved = self.scratch.save(df, name)
        free_shuffles(self.spark, self.n_heads)
        return saved

    @cached_property
    def ranks(self) -> DataFrame:
        ranks = (hd.rank_coded_heads(self._keyed_heads, self.n_heads, self._ranking, self.base.n) if self.broadcasts
                 else hd.rank_heads(self.heads, self.n_heads, self._ranking))
        ranks = self._saved(ranks, "head-ranks")
        self.heads  # noqa: B018 - saved before what it is read from goes
        self._ranking.delete()
        return ranks

    @cached_property
    def linked(self) -> DataFrame:
        ranks, parts = self.ranks, []
        for i in range(LINK_PASSES):  # by documents; the shuffle files of one pass are there at a time
            own = F.pmod(F.xxhash64("doc"), F.lit(LINK_PASSES)) == i
            parts.append(self._saved(hd.with_next_rank(self.heads.filter(own), ranks.filter(own), -(-self.n_heads // LINK_PASSES)),
                                     "linked-heads"))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def buckets(self) -> DataFrame:
        return self._saved(bk.bucket_counts(self.heads, self.index, self.scratch, self.base.n), "buckets")

    @cached_property
    def expanded(self) -> DataFrame:
        return self._saved(
            bk.expand_nonheads(self.heads, self.buckets, self.scratch, self.base.n), "expanded")

    @cached_property
    def nonheads(self) -> DataFrame:
        met = self._saved(bk.met_nonheads(self.linked, self.expanded), "met-nonheads")
        return self._saved(bk.placed_nonheads(self.linked, met), "nonheads")

    @cached_property
    def emitted_rows(self) -> int:
        return self.n_heads + self.nonheads.count() + self.buckets.filter("not has_head").count()

    @cached_property
    def gaps(self) -> DataFrame:
        return bk.gap_before_head(self.linked, self.nonheads, self.scratch, self.emitted_rows)

    @cached_property
    def _runs(self) -> DataFrame:
        self.emitted_rows  # noqa: B018 - makes the tables, whose shuffle files go before the rows are sorted
        return runs_of(bk.interleaved(self.linked, self.nonheads, self.buckets, self.emitted_rows, self.base.n), self.scratch)

    def runs(self) -> DataFrame:
        return self._runs

    def rl_bwt(self) -> DataFrame:
        return rl_bwt_columns(self._runs)

    def bwt(self) -> DataFrame:
        return expand_runs(self._runs)

    def close(self) -> None:
        """Drop the tables and the broadcast behind the relations."""
        if "arrays" in self.__dict__:
            self.arrays.destroy()
        self._ranking.delete()
        self.scratch.delete()
