"""Ranking and grouping of match heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch, partitions_for
from .matching import TEXT_KEY, head_key
from .ranking import rank_sequences

GROUP = ["pos", "len", "isa_next"]


def with_key(heads: DataFrame) -> DataFrame:
    """Add the class key of a head; separators are told apart by their document."""
    return heads.select("*", *head_key(), F.when(F.col("len") == 0, F.col("doc") + 1).otherwise(0).alias("tie"))


CLASS_KEY = ["isa_pos", "above", "reach", "isa_next", "tie"]


def rank_heads(heads: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """``doc, off, rank``: total order of the heads by the classes read from there on."""
    keyed = with_key(heads).select("doc", "off", *CLASS_KEY)
    return rank_sequences(keyed, CLASS_KEY, 1, scratch, rows, []).select("doc", "off", "rank")


def packed_class(n: int) -> Column | None:
    """``isa_pos, above, reach, isa_next`` in one number of the same order, if the base's ``n`` suffixes are few enough."""
    if (2 * n + 1) * n * n >= 1 << 63:
        return None
    # a reach is a length, negative above the base suffix
    reach = F.col("reach") + F.col("above") * (2 * n)
    return (F.col("isa_pos") * (2 * n + 1) + reach) * n + F.col("isa_next")


def rank_coded_heads(heads: DataFrame, rows: int, scratch: Scratch, n: int) -> DataFrame:
    """As ``rank_heads``, of heads with the first bits of their texts, which come in the same order as the classes and
    leave few heads to the rounds."""
    packed = packed_class(n)
    keys = [*TEXT_KEY[:2], *(CLASS_KEY[:4] if packed is None else ["class"]), TEXT_KEY[2]]
    keyed = heads.select("*", *head_key())
    keyed = (keyed if packed is None else keyed.withColumn("class", packed)).select("doc", "off", *keys)
    return rank_sequences(keyed, keys, 1, scratch, rows, []).select("doc", "off", "rank")


def with_next_rank(heads: DataFrame, ranks: DataFrame, rows: int) -> DataFrame:
    """Add the rank of each head's successor head.  A task holds the ranks of one slice of the ``rows`` heads."""
    key, parts = ["doc", "next_off"], partitions_for(heads.sparkSession, 2 * rows)
    succ = ranks.select("doc", F.col("off").alias("next_off"), F.col("rank").alias("next_rank"))
    return heads.repartition(parts, *key).join(succ.repartition(parts, *key).hint("shuffle_hash"), key)


def ordered_index(df: DataFrame, order: list[str], name: str, scratch: Scratch, rows: int,
                  weight: str | None = None) -> DataFrame:
    """Add ``name`` = number of rows (or sum of ``weight``) before each row in the
    order of ``order``, which must be unique.  Two levels: places inside range
    partitions, and the totals of the partitions before."""
    spark = df.sparkSession
    parts = partitions_for(spark, rows)
    placed = scratch.save(
        df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ordered")
    w = F.col(weight) if weight else F.lit(1)
    total = [(r.part, r.n) for r in placed.groupBy("part").agg(F.sum(w).cast("long").alias("n")).collect()]
    before, rows_before = 0, []
    for part, n in sorted(total):
        rows_before.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows_before, "part int, part_start long")  # one row per partition
    win = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.repartitionById(parts, "part").withColumn("upto", F.sum(w).over(win))
            .join(F.broadcast(offsets), "part")
            .withColumn(name, (F.col("part_start") + F.col("upto") - w).cast("long"))
            .drop("part", "part_start", "upto"))


def head_ids(heads: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Add ``head_id``, the place of a head in text order, and ``next_head_id``."""
    out = ordered_index(heads, ["doc", "off"], "head_id", scratch, rows)
    return out.withColumn("next_head_id", F.col("head_id") + F.col("next_off") - F.col("off"))


def head_groups(heads: DataFrame) -> DataFrame:
    """Heads with the same match and the same continuation: ``n_heads`` each."""
    return heads.groupBy(*GROUP).agg(
        F.first("smaller").alias("smaller"), F.first("run_len").alias("run_len"), F.count("*").alias("n_heads"))


def class_ranks(heads: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Add ``class_rank``: dense rank of the class keys, marked where a key differs from the one before."""
    return dense_index(with_key(heads), CLASS_KEY, ["doc", "off"], "class_rank", scratch, rows)


def dense_index(df: DataFrame, keys: list[str], tie: list[str], name: str, scratch: Scratch, rows: int) -> DataFrame:
    """Add ``name`` = how many different ``keys`` come before the row's.  ``tie`` tells rows of one key
    apart, so that a frequent key is split over partitions.

    Two levels, as in ``ordered_index``: changes of the key are counted inside range partitions;
    the first and the last key of each partition tell whether its first class goes on."""
    spark = df.sparkSession
    parts = partitions_for(spark, rows)
    placed = scratch.save(df.repartitionByRange(parts, *keys, *tie).withColumn("part", F.spark_partition_id()), "by-class")
    win = Window.partitionBy("part").orderBy(*keys, *tie)
    changed = F.lit(False)
    for k in keys:
        changed = changed | (F.col(k) != F.lag(k).over(win))
    marked = placed.repartitionById(parts, "part").withColumn("new_key", F.coalesce(changed, F.lit(False)).cast("long"))
    ranked = scratch.save(marked.withColumn("inside", F.sum("new_key").over(
        win.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new_key"), "class-marks")
    key = F.struct(*keys)
    ends = sorted(ranked.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("inside").alias("n"))
                  .collect(), key=lambda r: r.part)  # one row per partition
    starts, before, last = [], 0, None
    for r in ends:
        before += last is not None and r["first"] != last
        starts.append((r.part, before))
        before, last = before + r.n, r["last"]
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    return (ranked.join(F.broadcast(offsets), "part")
            .withColumn(name, F.col("part_start") + F.col("inside")).drop("part", "part_start", "inside"))
