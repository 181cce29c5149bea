"""Run-length encoding of ordered symbol rows, in two levels.

Each partition merges its own neighbours; one summary row per partition then says
which first run continues a run of an earlier partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.symbols import symbol_column
from ..session import Scratch, partitions_for

FRAGMENT_SCHEMA = "part int, seq long, at long, sym int, len long, last boolean, total long"


def merge_runs(batches):
    """Merge equal neighbours of the (rank, sym, weight) rows of one sorted partition,
    batch by batch; only the run that may go on is held."""
    part, seq, at, held_sym, held = TaskContext.get().partitionId(), 0, 0, None, 0

    def fragments(syms, lens, last):
        nonlocal seq, at
        n = len(syms)
        starts = at + np.cumsum(lens) - lens
        ends = np.zeros(n, dtype=bool)
        ends[-1] = last
        seqs = seq + np.arange(n)
        seq, at = seq + n, at + int(lens.sum())
        return pa.Table.from_pydict({
            "part": pa.array(np.full(n, part, dtype=np.int32)), "seq": seqs, "at": starts, "sym": syms.astype(np.int32),
            "len": lens, "last": ends, "total": pa.array(np.full(n, at), mask=~ends)}).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        sym = batch.column("sym").to_numpy()
        first = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        if "weight" in batch.schema.names:
            run = np.add.reduceat(batch.column("weight").to_numpy(), first)
        else:
            run = np.diff(np.append(first, len(sym)))
        syms, run = sym[first], run.astype(np.int64)
        if held and syms[0] == held_sym:
            run[0] += held
        elif held:
            syms, run = np.append(held_sym, syms), np.append(held, run)
        if len(syms) > 1:
            yield from fragments(syms[:-1], run[:-1], False)
        held_sym, held = syms[-1], int(run[-1])
    if held:
        yield from fragments(np.array([held_sym]), np.array([held], dtype=np.int64), True)


FIX_SCHEMA = "part int, runs_before long, symbols_before long, joins_prev boolean, more long"


def _stitch(ends: list) -> list[tuple]:
    """``ends``: (part, first sym, first length, last sym, runs, symbols) per partition."""
    rows, runs, symbols, prev = [], 0, 0, None
    owner = None  # partition whose last run is still growing
    for part, first, first_len, last, n, total in sorted(ends):
        joins = prev == first
        rows.append([part, runs - int(joins), symbols, joins, 0])
        if joins:
            owner[4] += first_len
        if not (joins and n == 1):
            owner = rows[-1]
        runs += n - int(joins)
        symbols, prev = symbols + total, last
    return [tuple(r) for r in rows]


def runs_of(ordered: DataFrame, scratch: Scratch) -> DataFrame:
    """``(run_id, bwt_idx, sym, run_len)`` of partitions that follow each other.

    ``ordered``: rows sorted inside their partition, with ``sym INT`` and, if they stand
    for several symbols, ``weight BIGINT``; ``bwt_idx`` is where the run starts."""
    return runs_of_fragments(ordered.mapInArrow(merge_runs, FRAGMENT_SCHEMA), scratch)


def runs_of_fragments(fragments: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``runs_of``, of the runs that each partition has merged."""
    spark = fragments.sparkSession
    frags = scratch.save(fragments, "fragments")
    firsts = {r.part: r for r in frags.filter("seq = 0").select("part", "sym", "len").collect()}
    ends = [(r.part, firsts[r.part].sym, firsts[r.part].len, r.sym, r.seq + 1, r.total)
            for r in frags.filter("last").select("part", "sym", "seq", "total").collect()]
    fix = spark.createDataFrame(_stitch(ends), FIX_SCHEMA)  # one row per partition
    return (frags.join(F.broadcast(fix), "part")
            .filter(~(F.col("joins_prev") & (F.col("seq") == 0)))
            .select((F.col("runs_before") + F.col("seq")).alias("run_id"),
                    (F.col("symbols_before") + F.col("at")).alias("bwt_idx"), "sym",
                    (F.col("len") + F.when(F.col("last"), F.col("more")).otherwise(0)).alias("run_len")))


def runs_of_ranks(ranked: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Runs of ``(rank, sym)`` rows whose ranks are 0..rows-1: the target partition
    follows from the rank, so nothing is sampled."""
    parts = partitions_for(ranked.sparkSession, rows)
    per_part = -(-max(rows, 1) // parts)
    ordered = ranked.select("rank", "sym").repartitionById(parts, F.expr(f"cast(rank div {per_part} as int)")).sortWithinPartitions("rank")
    return runs_of(ordered, scratch)


def rl_bwt_columns(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", symbol_column(F.col("sym")).alias("ch"), "run_len")


PIECE = 1 << 16  # most symbols of a run that one array holds
PIECES = 1 << 32  # symbols of the pieces that one array holds


def _pieces(runs: DataFrame, size: int) -> DataFrame:
    """The runs cut into pieces of at most ``size`` symbols."""
    at = F.explode(F.sequence(F.lit(0), F.expr(f"cast((run_len - 1) div {size} as int)")))
    return runs.select("bwt_idx", "sym", "run_len", at.alias("k")).select(
        (F.col("bwt_idx") + F.col("k").cast("long") * size).alias("bwt_idx"), "sym",
        F.least(F.lit(size), F.col("run_len") - F.col("k").cast("long") * size).alias("run_len"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """``(bwt_idx, ch)``: one row per symbol of the runs.  Long runs are cut into
    pieces, which are dealt to all tasks."""
    runs = runs.select("bwt_idx", "sym", "run_len")
    long = _pieces(_pieces(runs.filter(f"run_len > {PIECE}"), PIECES).repartition("bwt_idx"), PIECE).repartition("bwt_idx")
    return runs.filter(f"run_len <= {PIECE}").unionByName(long).select(
        F.explode(F.sequence("bwt_idx", F.col("bwt_idx") + F.col("run_len") - 1)).alias("bwt_idx"),
        symbol_column(F.col("sym")).alias("ch"))
