"""Total order of the suffixes of many sequences, by prefix multiplication.

Every element of a sequence starts with a few key columns that cover its first
``depth`` symbols.  A round sorts the open elements by (rank, ranks of the
elements ``depth``, ``2*depth`` and ``3*depth`` later) and so covers four times as
many symbols.  Elements whose rank is unique are closed and leave the rounds as
soon as no open element can still ask for their rank.

A rank is the number of smaller elements, so equal slices of the ranks make
partitions of bounded size without sampling.  Where a group of equal keys is
larger than a slice, and for the first sort, a range exchange over a key that is
unique per row splits it.  Ranks that cross a partition border are put right from
one summary row per partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import Scratch, free_shuffles, partitions_for

STEPS = 3  # looks ahead depth, 2*depth and 3*depth
NEXTS = [f"n{j}" for j in range(1, STEPS + 1)]
FIRST_SUB, FIRST_GROUP, TAIL, ALONE, WAS_OPEN = 1, 2, 4, 8, 16
SUMMARY_HEAD = 7
BLOCK = 1 << 16  # elements of a class that one window holds
FEW = 4  # where at most one element of so many is open, the open ones ask for ranks by a join


class _Marker:
    """Marks the rows of one partition, which come in key order, batch by batch.

    The ranks (``rk``, which is the first key after the first round) are refined by
    runs of equal keys.  Whether a row stands alone shows at the next one, so the last
    row of a batch waits for it; nothing else is held."""

    def __init__(self, keys: list[str], carry: list[str], first: bool):
        self.keys, self.first = keys, first
        self.names = ["doc", "off", *carry]
        self.part = TaskContext.get().partitionId()
        self.rows = self.alone = self.group_at = self.sub_at = self.largest = 0
        self.head = self.tail = None
        self.alone_first = self.alone_last = False
        self.waiting: pa.Table | None = None

    def take(self, table: pa.Table):
        if self.waiting is not None:
            table = pa.concat_tables([self.waiting, table])
        n = table.num_rows
        yield from self._emit(table, n - 1, False)
        self.waiting = table.slice(n - 1)

    def finish(self):
        yield from self._emit(self.waiting, 1, True)

    def _emit(self, table: pa.Table, n: int, end: bool):
        """Mark the first ``n`` rows; unless it is the end, one more row follows them."""
        if not n:
            return
        cols = [table.column(k).to_numpy() for k in self.keys]
        seen = len(cols[0])
        new_group, new_sub = np.zeros(seen + 1, dtype=bool), np.zeros(seen + 1, dtype=bool)
        if not self.first:
            new_group[1:seen] = cols[0][1:] != cols[0][:-1]
            new_group[0] = self.tail is None or cols[0][0] != self.tail[0]
        else:
            new_group[0] = self.tail is None
        new_sub[0] = self.tail is None or any(c[0] != t for c, t in zip(cols, self.tail))
        new_sub |= new_group
        for c in cols:
            new_sub[1:seen] |= c[1:] != c[:-1]
        new_sub[seen] = True
        at = self.rows + np.arange(n)
        group_at = np.maximum.accumulate(np.where(new_group[:n], at, self.group_at))
        sub_at = np.maximum.accumulate(np.where(new_sub[:n], at, self.sub_at))
        alone = new_sub[:n] & new_sub[1:n + 1]
        marks = (np.where(sub_at == 0, FIRST_SUB, 0) | np.where(group_at == 0, FIRST_GROUP, 0)
                 | np.where(alone, ALONE, 0))
        if end:
            marks[-1] |= TAIL
        marks |= WAS_OPEN if self.first else np.where(table.column("was_open").to_numpy()[:n], WAS_OPEN, 0)
        own = table.slice(0, n)
        out = {c: own.column(c) for c in self.names}
        out["rk"] = pa.array((sub_at - group_at) + (0 if self.first else cols[0][:n]))
        out["marks"] = pa.array(marks.astype(np.int32))
        out["part"] = pa.array(np.full(n, self.part, dtype=np.int32))
        out["summary"] = pa.nulls(n, pa.list_(pa.int64()))
        if self.head is None:
            self.head, self.alone_first = [int(c[0]) for c in cols], bool(alone[0])
        self.tail, self.alone_last = [int(c[n - 1]) for c in cols], bool(alone[-1])
        self.rows += n
        self.alone += int(alone.sum())
        self.group_at, self.sub_at = int(group_at[-1]), int(sub_at[-1])
        self.largest = max(self.largest, int((at - sub_at).max()) + 1)
        out = pa.Table.from_pydict(out)
        yield from out.to_batches(max_chunksize=1 << 16)
        if end:
            summary = [self.rows, self.alone, self.group_at, self.sub_at, int(self.alone_first), int(self.alone_last),
                       self.largest, *self.head, *self.tail]
            last = {f.name: pa.nulls(1, f.type) for f in out.schema}
            last["part"] = pa.array([self.part], pa.int32())
            last["summary"] = pa.array([summary], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(last.values()), schema=out.schema)


def _mark(keys: list[str], carry: list[str], first: bool):
    """Refine the ranks of one sorted partition by runs of equal keys, and add one summary row."""

    def run(batches):
        marker = _Marker(keys, carry, first)
        for batch in batches:
            if batch.num_rows:
                yield from marker.take(pa.Table.from_batches([batch]))
        if marker.waiting is not None:
            yield from marker.finish()

    return run


def _stitch(summaries: list[tuple[int, list[int]]], width: int, first: bool) -> tuple[list[tuple], int, int, int]:
    """Per partition: rows of its first group and shift of its first sub-group
    that lie in earlier partitions, and whether its ends continue elsewhere.
    Also the number of rows, of those that are not unique, and of the largest sub-group."""
    rows, total, unique, largest = [], 0, 0, 0
    last_key, group_rows, sub_shift, sub_rows, last_alone = None, 0, 0, 0, False
    for part, s in sorted(summaries):
        n, alone, group_at, sub_at, alone_first, alone_last, longest = s[:SUMMARY_HEAD]
        head, tail = s[SUMMARY_HEAD:SUMMARY_HEAD + width], s[SUMMARY_HEAD + width:]
        same_group = last_key is not None and (first or last_key[0] == head[0])
        same_sub = last_key == head
        before = group_rows if same_group else 0
        shift = sub_shift if same_sub else before
        if same_sub:
            unique -= int(last_alone) + alone_first
            rows[-1][4] = True
            alone_last = alone_last and n > 1
        rows.append([part, before, shift, same_sub, False])
        total, unique = total + n, unique + alone
        group_rows = before + n if group_at == 0 else n - group_at
        sub_shift = shift if sub_at == 0 else (before + sub_at if group_at == 0 else sub_at - group_at)
        sub_rows = n - sub_at + (sub_rows if same_sub and sub_at == 0 else 0)
        largest = max(largest, longest, sub_rows)
        last_key, last_alone = tail, bool(alone_last)
    return [tuple(r) for r in rows], total, total - unique, largest


FIX_SCHEMA = "part int, before long, first_shift long, joins_prev boolean, joins_next boolean"


def _ranked(placed: DataFrame, keys: list[str], carry: list[str], scratch: Scratch,
            first: bool = False) -> tuple[DataFrame, int, int, int]:
    """Refine the ranks of partitions that follow each other in key order.  Returns
    the elements with their ranks, their number, how many share theirs, and the
    size of the largest group."""
    spark = placed.sparkSession
    schema = T.StructType(
        [T.StructField(c, placed.schema[c].dataType) for c in ("doc", "off", *carry)]
        + T.StructType.fromDDL("rk long, marks int, part int, summary array<long>").fields)
    marked = scratch.save(placed.sortWithinPartitions(*keys).mapInArrow(_mark(keys, carry, first), schema), "ranks")
    summaries = [(r.part, r.summary) for r in
                 marked.filter(F.col("summary").isNotNull()).select("part", "summary").collect()]
    fixes, total, left, largest = _stitch(summaries, len(keys), first)
    free_shuffles(spark, total)
    fix = spark.createDataFrame(fixes, FIX_SCHEMA)  # one row per partition

    def has(flag):
        return F.col("marks").bitwiseAND(flag) != 0

    carried = F.when(has(FIRST_SUB), F.col("first_shift")).when(has(FIRST_GROUP), F.col("before")).otherwise(0)
    # a row that stands alone in its partition shares its key only across the border
    unique = has(ALONE) & ~(has(FIRST_SUB) & F.col("joins_prev")) & ~(has(TAIL) & F.col("joins_next"))
    ranked = (marked.filter(F.col("summary").isNull()).join(F.broadcast(fix), "part")
              .select("doc", "off", *carry, (F.col("rk") + carried).alias("rk"),
                      (~unique).alias("open"), has(WAS_OPEN).alias("was_open")))
    return ranked, total, left, largest


def _look_ahead(ranks: DataFrame, depth: int, parts: int) -> DataFrame:
    """Add the ranks of the elements 1, 2 and 3 times ``depth`` later; drop the
    closed elements that no open one will ask for again.

    Elements that lie multiples of ``depth`` apart form a class, and a class is cut into
    blocks, to which the first elements of the next block and the last one of the block
    before are added: no window grows with the length of a document."""
    step = F.expr(f"off div {depth}")
    within, block = F.pmod(step, F.lit(BLOCK)), F.expr(f"off div {depth} div {BLOCK}")
    blocks = F.array_compact(F.array(
        block, F.when((within < STEPS) & (block > 0), block - 1), F.when(within == BLOCK - 1, block + 1)))
    dealt = ranks.withColumns({"class": F.col("off") % depth, "own": block, "block": F.explode(blocks)})
    w = Window.partitionBy("doc", "class", "block").orderBy("off")
    ahead = dealt.repartition(parts, "doc", "class", "block").withColumns(
        {f"o{j}": F.lead("off", j).over(w) for j in range(1, STEPS + 1)}
        | {f"r{j}": F.lead("rk", j).over(w) for j in range(1, STEPS + 1)}
        | {"po": F.lag("off").over(w), "asks": F.lag("open").over(w)}).filter("own = block")
    nexts = [F.when(F.col("open") & (F.col(f"o{j}") == F.col("off") + j * depth), F.col(f"r{j}") + 1)
             .otherwise(0).alias(f"n{j}") for j in range(1, STEPS + 1)]
    asked = F.coalesce((F.col("po") == F.col("off") - depth) & F.col("asks"), F.lit(False))
    return ahead.filter(F.col("open") | asked).select(
        *[c for c in ranks.columns if c not in ("open", "was_open")], F.col("open").alias("was_open"), *nexts)


def _ask_ahead(ranks: DataFrame, depth: int, parts: int) -> DataFrame:
    """The rows of ``_look_ahead`` where few elements are open: those ask for the ranks they need, and the others
    cross one exchange, with their rank alone, to be met or dropped."""
    given = [c for c in ranks.columns if c not in ("doc", "off", "rk", "open", "was_open")]
    zero = F.lit(0).cast("long")
    own = ranks.filter("open").select("doc", "off", "rk", F.lit(True).alias("was_open"), *[zero.alias(n) for n in NEXTS], *given)
    asks = ranks.filter("open").select("doc", "off", F.explode(F.array(*[F.lit(j) for j in range(1, STEPS + 1)])).alias("j"))
    asks = asks.withColumn("at", F.col("off") + F.col("j") * depth)
    # a slice of the ranks' size has at most STEPS / FEW of its rows asked for
    met = ranks.select("doc", F.col("off").alias("at"), "rk", "open").repartition(parts, "doc", "at").join(
        asks.repartition(parts, "doc", "at").hint("shuffle_hash"), ["doc", "at"])
    answer = F.struct("doc", "off", F.lit(None).cast("long").alias("rk"),
                      *[F.when(F.col("j") == j + 1, F.col("rk") + 1).otherwise(0).alias(n) for j, n in enumerate(NEXTS)])
    asked = F.struct("doc", F.col("at").alias("off"), "rk", *[zero.alias(n) for n in NEXTS])
    rows = met.select(F.explode(F.array_compact(F.array(
        answer, F.when((F.col("j") == 1) & ~F.col("open"), asked)))).alias("row")).select(
        "row.*", F.lit(False).alias("was_open"), *[F.lit(None).cast(ranks.schema[c].dataType).alias(c) for c in given])
    return own.unionByName(rows).groupBy("doc", "off").agg(
        *[F.max(c).alias(c) for c in [*given, "rk", "was_open", *NEXTS]])


def rank_sequences(elements: DataFrame, keys: list[str], depth: int, scratch: Scratch,
                   rows: int, carry: list[str], rounds: list | None = None) -> DataFrame:
    """Rank of every element among all elements by the sequence that starts there.

    ``elements``: ``doc, off``, BIGINT ``keys`` covering ``depth`` elements at least, ``carry``;
    ``rows`` of them.  The keys must tell apart equal sequences of different documents,
    which a closing element of its own per document does.  Returns
    ``doc, off, *carry, rank``.  ``rounds`` is given what each round has covered and
    ``doc, off, rk`` of the elements that shared their rank after it.
    """
    spark = elements.sparkSession
    parts = partitions_for(spark, rows)
    slice_rows = -(-max(rows, 1) // parts)
    placed = elements.select("doc", "off", *carry, *keys).repartitionByRange(parts, *keys, "doc", "off")
    ranks, total, left, largest = _ranked(placed, keys, carry, scratch, first=True)
    done = [ranks.filter(~F.col("open"))]
    rounds = [] if rounds is None else rounds
    while left:
        rounds.append((depth, ranks.filter("open").select("doc", "off", "rk")))
        ahead = (_ask_ahead if FEW * left <= total else _look_ahead)(ranks, depth, partitions_for(spark, total))
        if largest <= slice_rows:
            placed = ahead.repartitionById(parts, F.expr(f"cast(rk div {slice_rows} as int)"))
        else:
            placed = ahead.repartitionByRange(partitions_for(spark, 2 * left), "rk", *NEXTS, "doc", "off")
        ranks, total, left, largest = _ranked(placed, ["rk", *NEXTS], carry, scratch)
        done.append(ranks.filter(F.col("was_open") & ~F.col("open")))
        depth *= STEPS + 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("doc", "off", *carry, F.col("rk").alias("rank"))
