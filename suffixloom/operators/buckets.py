"""Buckets of positions by matched base suffix, and their interleaving with heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch, large, partitions_for
from .heads import ordered_index, packed_class

KEY = ["isa_pos", "above", "reach", "isa_next", "next_rank"]


def bucket_counts(heads: DataFrame, index: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """``pos, isa_pos, sym, cnt, has_head`` of the buckets that are not empty; ``sym`` is the
    symbol before the base suffix, which the non-heads of the bucket have before them too.

    A head covers ``pos .. pos + run_len``; the cover of a base position is the
    running sum of starts and ends, so heads are never expanded."""
    edges = (heads.select(F.explode(F.array(
        F.struct(F.col("pos").alias("at"), F.lit(1).alias("d"), F.lit(1).alias("h")),
        F.struct((F.col("pos") + F.col("run_len") + 1).alias("at"), F.lit(-1).alias("d"), F.lit(0).alias("h"))))
        .alias("e")).groupBy("e.at").agg(F.sum("e.d").alias("d"), F.max("e.h").alias("h")))
    steps = index.select("pos", F.col("isa").alias("isa_pos"), F.col("prev").alias("sym")).join(
        large(edges.withColumnRenamed("at", "pos")), "pos", "left").fillna(0, ["d", "h"])
    summed = ordered_index(steps, ["pos"], "below", scratch, n, weight="d")
    return (summed.select("pos", "isa_pos", "sym", (F.col("below") + F.col("d")).alias("cnt"),
                          (F.col("h") == 1).alias("has_head")).filter("cnt > 0"))


def expand_nonheads(heads: DataFrame, buckets: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """The positions after a head that fall into buckets with heads, one row per
    distinct ``(pos, above, reach, isa_next)`` of ``cnt`` positions each, with the bucket's ``sym``.

    Runs with the same match are collapsed first.  The buckets with heads inside a
    run are numbered in base order, so a run finds them by two equi-joins."""
    runs = (heads.filter("run_len > 0").groupBy("pos", "len", "smaller", "isa_next", "run_len")
            .agg(F.count("*").alias("cnt")))
    marked = scratch.save(ordered_index(
        buckets.select("pos", F.col("isa_pos").alias("b_isa"), "sym", F.col("has_head").cast("long").alias("h")),
        ["pos"], "before", scratch, n, weight="h"), "head-buckets")
    # every position of a run has a bucket, so both ends are found
    lo = marked.select("pos", (F.col("before") + F.col("h")).alias("lo"))
    hi = marked.select(F.col("pos").alias("end"), (F.col("before") + F.col("h") - 1).alias("hi"))
    numbered = marked.filter("h = 1").select(F.col("before").alias("k"), F.col("pos").alias("b_pos"), "b_isa", "sym")
    spans = (runs.withColumn("end", F.col("pos") + F.col("run_len")).join(large(lo), "pos").join(large(hi), "end")
             .filter("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi"))).join(large(numbered), "k"))
    gone = F.col("b_pos") - F.col("pos")
    return spans.select(
        F.col("b_pos").alias("pos"), F.col("b_isa").alias("isa_pos"), "sym", (~F.col("smaller")).cast("long").alias("above"),
        F.when(F.col("smaller"), F.col("len") - gone).otherwise(gone - F.col("len")).alias("reach"), "isa_next",
        F.col("pos").alias("r_pos"), F.col("len").alias("r_len"), F.col("smaller").alias("r_smaller"),
        F.col("run_len").alias("r_run"), "cnt")


def placed_heads(heads: DataFrame) -> DataFrame:
    """Heads (with ``next_rank``) by their order key; separators by document."""
    last = F.when(F.col("len") == 0, F.col("doc")).otherwise(F.col("next_rank"))
    return heads.select(
        "doc", "off", "isa_pos", (~F.col("smaller")).cast("long").alias("above"),
        F.when(F.col("smaller"), F.col("len")).otherwise(-F.col("len")).alias("reach"), "isa_next",
        last.alias("next_rank"), "sym")


def met_nonheads(heads: DataFrame, expanded: DataFrame) -> DataFrame:
    """``expanded`` with ``tied``: whether a head has the same first four parts of the order key."""
    four = KEY[:4]
    taken = placed_heads(heads).filter("reach <> 0").select(*four).distinct().withColumn("taken", F.lit(True))
    return expanded.join(large(taken), four, "left").withColumn("tied", F.col("taken").isNotNull()).drop("taken")


def placed_nonheads(heads: DataFrame, met: DataFrame) -> DataFrame:
    """Weighted non-head rows by order key, of rows from ``met_nonheads``.  Only rows that tie with a head on the
    first four parts of the key need the successor ranks of their members."""
    four = KEY[:4]
    free = (met.filter("not tied").groupBy("pos", "sym", *four).agg(F.sum("cnt").alias("weight"))
            .withColumn("next_rank", F.lit(-1).cast("long")))
    # equal documents share all of this, so their members are counted before they are joined; runs alone have non-heads
    members = heads.filter("run_len > 0").groupBy(
        F.col("pos").alias("r_pos"), F.col("len").alias("r_len"), F.col("smaller").alias("r_smaller"),
        F.col("run_len").alias("r_run"), "isa_next", "next_rank").agg(F.count("*").alias("members"))
    tied = (met.filter("tied").join(large(members), ["r_pos", "r_len", "r_smaller", "r_run", "isa_next"])
            .groupBy("pos", "sym", *KEY).agg(F.sum("members").alias("weight")))
    return free.unionByName(tied)


def gap_before_head(heads: DataFrame, nonheads: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """``doc, off, rank, gap``: non-heads between a head and the head before it in
    the same bucket.  Heads precede non-heads of the same key only if they tie.

    One range exchange: heads and gaps are counted inside the sorted partitions, and one
    summary row per partition tells what a bucket that crosses a border carries over."""
    both = placed_heads(heads).select("doc", "off", *KEY, F.lit(0).cast("long").alias("weight"), F.lit(1).alias("head"))
    rest = nonheads.select(F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("off"), *KEY,
                           "weight", F.lit(0).alias("head"))
    spark, order = heads.sparkSession, [*KEY, "head"]
    parts = partitions_for(spark, rows)
    sorted_ = scratch.save(both.unionByName(rest).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()),
                           "gap-rows").repartitionById(parts, "part")
    own = Window.partitionBy("part", "isa_pos").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sorted_.withColumns({
        "count": F.sum("weight").over(upto),
        "place": F.sum("head").over(Window.partitionBy("part").orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow))})
    before = F.last(F.when(F.col("head") == 1, F.col("count")), ignorenulls=True).over(
        own.rowsBetween(Window.unboundedPreceding, -1))
    marked = scratch.save(counted.withColumn("count_before", before), "gaps")
    # of each partition's last bucket: what follows its last head, or all of it if it has none
    ends = marked.groupBy("part", "isa_pos").agg(
        F.max("count").alias("all"), F.max(F.when(F.col("head") == 1, F.col("count"))).alias("at_head"), F.max("place").alias("heads"))
    summary = ends.groupBy("part").agg(
        F.min("isa_pos").alias("first"), F.max("isa_pos").alias("last"), F.max("heads").alias("heads"),
        F.max_by(F.struct("all", "at_head"), "isa_pos").alias("end")).collect()  # one row per partition
    carries, heads_before, open_bucket, open_weight = [], 0, None, 0
    for r in sorted(summary, key=lambda r: r.part):
        carries.append((r.part, heads_before, r["first"], open_weight if r["first"] == open_bucket else 0))
        heads_before += r.heads
        if r.end.at_head is not None:
            open_weight = r.end["all"] - r.end.at_head
        else:
            open_weight = r.end["all"] + (open_weight if r["last"] == open_bucket else 0)
        open_bucket = r["last"]
    carry = spark.createDataFrame(carries, "part int, heads_before long, carried_bucket long, carried long")
    over = F.when((F.col("isa_pos") == F.col("carried_bucket")) & F.col("count_before").isNull(), F.col("carried")).otherwise(0)
    return (marked.filter("head = 1").join(F.broadcast(carry), "part").select(
        "doc", "off", (F.col("heads_before") + F.col("place") - 1).alias("rank"),
        (F.col("count") - F.coalesce("count_before", F.lit(0)) + over).alias("gap")))


def interleaved(heads: DataFrame, nonheads: DataFrame, buckets: DataFrame, rows: int, n: int) -> DataFrame:
    """``rank, sym, weight`` in BWT order: the heads, the non-heads around them, and
    whole buckets without heads.  All rows bring their symbol with them.  ``n``: suffixes of the base."""
    head_rows = placed_heads(heads).select(*KEY, F.lit(1).alias("head"), "sym", F.lit(1).cast("long").alias("weight"))
    zero = F.lit(0).cast("long")
    plain = (buckets.filter(~F.col("has_head"))
             .select("isa_pos", *[zero.alias(k) for k in KEY[1:]], F.lit(0).alias("head"), "sym",
                     F.col("cnt").alias("weight")))
    mixed = nonheads.select(*KEY, F.lit(0).alias("head"), "sym", "weight")
    rows_of_all, packed = head_rows.unionByName(mixed).unionByName(plain), packed_class(n)
    order = [*KEY, "head", "sym"]
    if packed is not None:  # one key of many values sorts faster than four of few
        order = ["class", *order[4:]]
        rows_of_all = rows_of_all.select(packed.alias("class"), *order[1:], "weight")
    return (rows_of_all.repartitionByRange(partitions_for(heads.sparkSession, rows), *order).sortWithinPartitions(*order)
            .select(F.monotonically_increasing_id().alias("rank"), "sym", "weight"))
