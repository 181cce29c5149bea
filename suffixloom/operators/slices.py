"""Neighbours and running values in a dense order, in slices of bounded size.

Rows whose ranks are 0, 1, 2.. are dealt by equal slices of the rank, which needs no
sampling; the rows at a slice's borders are dealt to the slice beside it as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import partitions_for


def _per_slice(df: DataFrame, rows: int) -> tuple[int, int]:
    parts = partitions_for(df.sparkSession, rows)
    return parts, -(-max(rows, 1) // parts)


def with_neighbours(df: DataFrame, rank: str, rows: int, before: dict[str, str] | None = None,
                    after: dict[str, str] | None = None) -> DataFrame:
    """Add columns of the row before (``before``: new name -> column) and after each row; null at the ends."""
    parts, per = _per_slice(df, rows)
    own, place = F.expr(f"cast({rank} div {per} as int)"), F.expr(f"{rank} % {per}")
    dealt = df.withColumns({"own_slice": own, "slice": F.explode(F.array_compact(F.array(
        own, F.when((place == 0) & (own > 0), own - 1), F.when(place == per - 1, own + 1))))})
    w = Window.partitionBy("slice").orderBy(rank)
    return (dealt.repartitionById(parts + 1, "slice").withColumns(
        {new: F.lag(c).over(w) for new, c in (before or {}).items()}
        | {new: F.lead(c).over(w) for new, c in (after or {}).items()})
        .filter("slice = own_slice").drop("slice", "own_slice"))


def with_nearest(df: DataFrame, rank: str, rows: int, marked: Column, value: str) -> DataFrame:
    """Add ``below`` and ``above``: ``value`` of the nearest row before and after in the order of
    ``rank`` for which ``marked`` holds; null where there is none.

    Two levels: inside the slices, and over one summary row per slice."""
    spark = df.sparkSession
    parts, per = _per_slice(df, rows)
    sliced = df.withColumns({"slice": F.expr(f"cast({rank} div {per} as int)"), "marked_value": F.when(marked, F.col(value))})
    ends = sliced.filter(marked).groupBy("slice").agg(
        F.min_by(value, rank).alias("first"), F.max_by(value, rank).alias("last")).collect()  # one row a slice
    first, last = {r.slice: r["first"] for r in ends}, {r.slice: r["last"] for r in ends}
    borders, seen = [[s, None, None] for s in range(parts)], None
    for s in range(parts):
        borders[s][1] = seen
        seen = last.get(s, seen)
    seen = None
    for s in reversed(range(parts)):
        borders[s][2] = seen
        seen = first.get(s, seen)
    border = spark.createDataFrame(borders, "slice int, slice_below long, slice_above long")
    w = Window.partitionBy("slice").orderBy(rank)
    down = F.last("marked_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    up = F.last("marked_value", ignorenulls=True).over(
        Window.partitionBy("slice").orderBy(F.col(rank).desc()).rowsBetween(Window.unboundedPreceding, -1))
    return (sliced.repartitionById(parts, "slice").withColumns({"below": down, "above": up})
            .join(F.broadcast(border), "slice")
            .withColumns({"below": F.coalesce("below", "slice_below"), "above": F.coalesce("above", "slice_above")})
            .drop("slice", "slice_below", "slice_above", "marked_value"))
