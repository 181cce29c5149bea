"""Scratch tables and sizing rules shared by all operators.

Iterative operators cut their lineage by writing each round as a parquet table
below the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROWS_PER_PARTITION_CONF = "spark.suffixloom.rowsPerPartition"
MAX_PARTITIONS_CONF = "spark.suffixloom.maxPartitions"
SMALL_PARTITION_ROWS = 1 << 15
FREE_ROWS = 1 << 20  # shuffle files of smaller steps may wait
MAX_INDEX_SYMBOLS_CONF = "spark.suffixloom.maxIndexSymbols"
#: Longest base whose index is broadcast: the driver holds about 100 bytes a symbol of it.
BROADCAST_SYMBOLS = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    root = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


class Scratch:
    """One job's folder of intermediate tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/suffixloom-{uuid.uuid4().hex}"
        self._tables = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back, which has no lineage."""
        self._tables += 1
        path = f"{self.path}/{self._tables:03d}-{name}"
        df.write.option("compression", "lz4_raw").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        """Drop the tables, once nothing that reads them is needed any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, rows: int) -> int:
    """How many partitions hold ``rows`` rows; bounded, as one summary row per
    partition reaches the driver."""
    per_part = int(spark.conf.get(ROWS_PER_PARTITION_CONF, str(1 << 20)))
    most = int(spark.conf.get(MAX_PARTITIONS_CONF, "100000"))
    use_cores = min(spark.sparkContext.defaultParallelism, -(-rows // SMALL_PARTITION_ROWS))
    return max(1, use_cores, min(most, -(-rows // per_part)))


def max_index_symbols(spark: SparkSession) -> int:
    """Longest base string that the driver may hold."""
    return int(spark.conf.get(MAX_INDEX_SYMBOLS_CONF, str(1 << 24)))


def broadcast_symbols(spark: SparkSession) -> int:
    """Longest base string whose index is broadcast to the Python workers; longer ones are matched by joint ranks."""
    return min(max_index_symbols(spark), BROADCAST_SYMBOLS)


def free_shuffles(spark: SparkSession, rows: int) -> None:
    """Let Spark drop the shuffle files of steps whose result of ``rows`` rows is saved.  It does so once the driver's
    JVM has collected their plans, which it seldom does by itself when it has memory to spare.  Spark's listeners hold
    on to the last plan they have seen, so a small one follows it."""
    if rows >= FREE_ROWS:
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input.  Rows made from texts, or read back from a compressed table, are
    estimated at a small part of their size, at which Spark would collect and broadcast them."""
    return df.hint("merge")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give a scan with fewer splits than cores enough partitions to use them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *key)
