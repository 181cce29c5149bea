"""The base string of a collection and its suffix index as a DataFrame.

The base string is the data every document is matched against.  It is kept as rows of
``BLOCK`` symbols each; no task and no driver ever holds it whole.  Its index has one
row per suffix (the empty one included)::

    pos BIGINT, isa BIGINT, prev INT, lcp BIGINT, uniq_len BIGINT
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.nearest import nearest_smaller
from ..functions.symbols import BASE_END, FIRST_CODE, LEGAL_HIGH, LEGAL_LOW, Alphabet, codes_of
from ..session import Scratch, max_index_symbols
from .common_prefix import History, common_prefix
from .pieces import is_binary, reblocked
from .ranking import rank_sequences
from .slices import with_neighbours
from .suffixes import PACKED_LONGS, piece_suffix_rows, symbol_counts

BLOCK = 1 << 16  # symbols of the base in one row
#: The base as a document among others; before all of them, as its end sorts before theirs.
BASE_DOC = -(1 << 62)


class BaseTooLong(ValueError):
    """The base string is longer than what may be broadcast or held by the driver."""


@dataclass(frozen=True)
class BaseString:
    """``base || symbols it lacks, ascending``, followed by an end of its own that sorts
    before every symbol; ``n`` counts its suffixes, with the one of the end and the empty one.

    ``blocks``: ``block BIGINT, text`` rows of ``size`` symbols, the last one shorter."""

    blocks: DataFrame
    symbols: int
    base_len: int
    size: int

    @property
    def n(self) -> int:
        return self.symbols + 2

    @property
    def text(self) -> str | bytes:
        """The whole string, on the driver; refused if it is longer than an index that may be broadcast."""
        if self.symbols > max_index_symbols(self.blocks.sparkSession):
            raise BaseTooLong(f"base string of {self.symbols} symbols")
        rows = [r.text for r in self.blocks.orderBy("block").select("text").collect()]  # of bounded size
        return b"".join(map(bytes, rows)) if is_binary(self.blocks) else "".join(rows)

    @property
    def codes(self) -> np.ndarray:
        """Symbols from FIRST_CODE on, then BASE_END."""
        return np.append(codes_of([self.text]).astype(np.int64) + FIRST_CODE, BASE_END)


def _reblocked(placed: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """``block, text`` of a text that comes as ``start, text`` rows."""
    return reblocked(placed.withColumn("doc", F.lit(BASE_DOC)), size, halo).select("block", "text")


def concat_base(parts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``block, text``: all rows of ``parts (doc, text)`` in order, without separator, in blocks of ``BLOCK`` symbols."""
    scratch = scratch or Scratch(parts.sparkSession)
    return scratch.save(_reblocked(_placed(parts, ["doc"], scratch), BLOCK), "base-blocks")


def _placed(parts: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    from .heads import ordered_index

    sized = parts.select(*order, "text", F.length("text").cast("long").alias("size"))
    return ordered_index(sized, order, "start", scratch, sized.count(), weight="size")


def base_parts(base: DataFrame) -> DataFrame:
    """``doc, text`` of a base that is one ``text``, or comes as ``block, text`` rows of ``BLOCK`` symbols."""
    order = F.col("block") if "block" in base.columns else F.lit(0).cast("long")
    return base.select(order.alias("doc"), "text")


def base_symbols(base: DataFrame) -> int:
    return base.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


def missing_symbols(base: DataFrame, collection: DataFrame) -> DataFrame:
    """``code``: legal symbols and symbols of the collection that the base lacks."""
    spark = base.sparkSession
    have = symbol_counts(base_parts(base)).select("code")
    legal = spark.range(LEGAL_LOW, LEGAL_HIGH + 1).select(F.col("id").alias("code"))
    seen = symbol_counts(collection).filter("code >= 0").select("code")
    return legal.unionByName(seen).distinct().join(have, "code", "left_anti")


def augment(base: DataFrame, collection: DataFrame, scratch: Scratch | None = None) -> BaseString:
    """Append to the base what lets every symbol of the collection match."""
    spark = base.sparkSession
    scratch = scratch or Scratch(spark)
    placed = base_parts(base).filter(F.length("text") > 0).select((F.col("doc") * BLOCK).alias("start"), "text")
    length = base_symbols(placed)
    codes = sorted(r.code for r in missing_symbols(base, collection).collect())  # at most one per symbol
    tail = bytes(codes) if is_binary(base) else "".join(map(chr, codes))
    last = spark.createDataFrame([(length, tail)], T.StructType([
        T.StructField("start", T.LongType()), T.StructField("text", base.schema["text"].dataType)]))
    blocks = _reblocked(placed.unionByName(last), BLOCK)
    return BaseString(scratch.save(blocks, "base-blocks"), length + len(tail), length, BLOCK)


def base_suffixes(base: BaseString, alphabet: Alphabet) -> DataFrame:
    """The suffix rows of the base, from blocks with the symbols around them."""
    placed = base.blocks.select(F.lit(BASE_DOC).alias("doc"), (F.col("block") * base.size).alias("start"), "text")
    return piece_suffix_rows(placed, alphabet, base.size)


def _alphabet(counts: DataFrame) -> Alphabet:
    return Alphabet(tuple(sorted(r.code for r in counts.filter("code >= 0").select("code").distinct().collect())))


def base_index(spark: SparkSession, base: BaseString, scratch: Scratch) -> DataFrame:
    """Suffix array, inverse, preceding symbols, LCP and uniqueness threshold."""
    alphabet = _alphabet(symbol_counts(base.blocks.select(F.col("block").alias("start"), "text")))
    elements = base_suffixes(base, alphabet)
    history = History(elements.select("doc", "off", "k1", "k2"), alphabet)
    ranked = rank_sequences(elements, ["k1", "k2", "tie"], PACKED_LONGS * alphabet.per_long, scratch,
                            base.symbols + 1, ["sym"], history.rounds)
    # the end of the text stands for the suffix of the end symbol; the empty suffix comes before it
    ranks = scratch.save(ranked.select(F.col("off").alias("pos"), F.col("rank"), F.col("sym").alias("prev")), "base-ranks")
    pairs = with_neighbours(ranks, "rank", base.symbols + 1, before={"b_off": "pos"}).select(
        F.lit(BASE_DOC).alias("a_doc"), F.col("pos").alias("a_off"), F.lit(BASE_DOC).alias("b_doc"), "b_off", "rank", "prev")
    shared = common_prefix(pairs, history, scratch).select(
        F.col("a_off").alias("pos"), (F.col("rank") + 1).alias("isa"), "prev", F.col("n").alias("lcp"))
    zero = F.lit(0).cast("long")
    first = ranks.filter("rank = 0").select("pos", F.lit(1).cast("long").alias("isa"), "prev", zero.alias("lcp"))
    empty = spark.range(1).select(F.lit(base.n - 1).cast("long").alias("pos"), zero.alias("isa"),
                                  F.lit(BASE_END).alias("prev"), zero.alias("lcp"))
    known = shared.unionByName(first).unionByName(empty)
    return scratch.save(
        with_neighbours(known, "isa", base.n, after={"next_lcp": "lcp"})
        .select("pos", "isa", "prev", "lcp",
                F.greatest("lcp", F.coalesce("next_lcp", F.lit(-1))).alias("uniq_len")), "base-index")


def _lcp_array(index: DataFrame):
    """LCP by suffix order, ended by -1; refused where the base may not be broadcast."""
    n, most = index.count(), max_index_symbols(index.sparkSession)
    if n > most + 2:
        raise BaseTooLong(f"index of {n} suffixes")
    rows = index.select("isa", "lcp").toArrow()
    lcp = np.full(rows.num_rows + 1, -1, dtype=np.int64)
    lcp[rows["isa"].to_numpy()] = rows["lcp"].to_numpy()
    return index.sparkSession.sparkContext.broadcast(lcp)


def smaller_values(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For ``probes (.., at, bound)``: ``psv`` = last j <= at and ``nsv`` = first
    j >= at with lcp[j] < bound, or -1."""
    lcp = _lcp_array(index)
    names = probes.columns
    schema = T.StructType(list(probes.schema.fields)).add("psv", "long").add("nsv", "long")

    def run(frames):
        for pdf in frames:
            at, bound = pdf["at"].to_numpy(), pdf["bound"].to_numpy()
            nsv = nearest_smaller(lcp.value, at, bound, 1)
            psv = nearest_smaller(lcp.value, at, bound, -1)
            yield pdf.assign(psv=psv, nsv=np.where(nsv == len(lcp.value) - 1, -1, nsv))

    return probes.mapInPandas(run, schema).select(*names, "psv", "nsv")


def lcp_intervals(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For ``probes (.., lo, hi, len)``: the widest interval ``left, right`` around
    ``[lo, hi]`` whose suffixes share ``len`` symbols."""
    lcp = _lcp_array(index)
    names = probes.columns
    schema = T.StructType(list(probes.schema.fields)).add("left", "long").add("right", "long")

    def run(frames):
        for pdf in frames:
            bound = pdf["len"].to_numpy()
            left = nearest_smaller(lcp.value, pdf["lo"].to_numpy(), bound, -1)
            right = nearest_smaller(lcp.value, pdf["hi"].to_numpy() + 1, bound, 1)
            last = len(lcp.value) - 2
            yield pdf.assign(left=np.maximum(left, 0), right=np.where(right < 0, last, right - 1))

    return probes.mapInPandas(run, schema).select(*names, "left", "right")


def contract_left(index: DataFrame, probes: DataFrame, base: BaseString) -> DataFrame:
    """Drop the first symbol of the match in ``[lo, hi]`` and widen to the interval
    of the remaining ``len`` symbols; the root if a suffix has nothing left."""
    nxt = index.select((F.col("pos") - 1).alias("p"), F.col("isa").alias("next_isa"))
    by_rank = index.select("isa", F.col("pos").alias("p"))
    step = by_rank.join(nxt, "p", "left").select(F.col("isa"), "next_isa")
    names = probes.columns
    moved = (probes.join(step.select(F.col("isa").alias("lo"), F.col("next_isa").alias("lo2")), "lo")
             .join(step.select(F.col("isa").alias("hi"), F.col("next_isa").alias("hi2")), "hi"))
    root = F.col("lo2").isNull() | F.col("hi2").isNull()
    wide = lcp_intervals(index, moved.select(
        *names, root.alias("root"), F.col("len"),
        F.coalesce("lo2", F.lit(0)).alias("lo_next"), F.coalesce("hi2", F.lit(0)).alias("hi_next"))
        .select(*[F.col(c).alias(f"in_{c}") for c in names], "root",
                F.col("lo_next").alias("lo"), F.col("hi_next").alias("hi"), "len"))
    return wide.select(
        *[F.col(f"in_{c}").alias(c) for c in names],
        F.when(F.col("root"), 0).otherwise(F.col("left")).alias("left"),
        F.when(F.col("root"), base.n - 1).otherwise(F.col("right")).alias("right"))


def block_minima(index: DataFrame, size: int = 128) -> DataFrame:
    """Minimum LCP per block of ``size`` neighbours in suffix order."""
    return index.groupBy(F.expr(f"isa div {size}").alias("block")).agg(F.min("lcp").alias("min_lcp"))
