"""Headline queries; prints one JSON line.  BENCH_SF_DIR, BENCH_CPUS set the input and cores."""

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from suffixloom.operators.base_index import concat_base
from suffixloom.plans.compressed import CompressedBwt
from suffixloom.plans.suffix_sort import rank_suffixes
from suffixloom.queries import collection, first_text

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df):
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def by_suffixes(name, out):
    def run(spark):
        plan = rank_suffixes(collection(spark, SF_DIR, name))
        consume(getattr(plan, out)())
        plan.close()
    return run


def by_heads(name, out):
    def run(spark):
        docs = collection(spark, SF_DIR, name)
        plan = CompressedBwt(docs, first_text(docs))
        consume(getattr(plan, out)() if out != "matches" else plan.matches)
        plan.close()
    return run


def near_copies(strategy):
    """The texts of one conversation table, joined, with a share of symbols replaced: near copies of a long base."""
    def run(spark):
        turns = collection(spark, SF_DIR, "conversations").filter("doc < 400")
        base = concat_base(turns)
        whole = turns.agg(F.sort_array(F.collect_list(F.struct("doc", "text"))).alias("p")).select(
            F.array_join("p.text", "").alias("text"))
        changed = F.transform(F.split("text", ""), lambda c, i: F.when(
            F.pmod(F.xxhash64(F.col("doc"), i), F.lit(1000)) == 0, F.lit("#")).otherwise(c))
        docs = whole.withColumn("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long")))).select(
            "doc", F.array_join(changed, "").alias("text"))
        plan = CompressedBwt(docs, base) if strategy == "heads" else rank_suffixes(docs)
        consume(plan.rl_bwt())
        plan.close()
    return run


QUERIES = {
    "rl_bwt_documents": by_suffixes("documents", "rl_bwt"),
    "bwt_conversations": by_suffixes("conversations", "bwt"),
    "rl_bwt_pages": by_suffixes("pages", "rl_bwt"),
    "bwt_events": by_suffixes("events", "bwt"),
    "rl_bwt_heads_customer": by_heads("customer", "rl_bwt"),
    "rl_bwt_heads_events": by_heads("events", "rl_bwt"),
    "matching_statistics_documents": by_heads("documents", "matches"),
    "rl_bwt_near_copies_heads": near_copies("heads"),
    "rl_bwt_near_copies_suffixes": near_copies("suffixes"),
}


def main():
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("suffixloom-bench")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "20g"))
             .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).mapInArrow(lambda it: it, "id long").count()  # start the workers
    times = {}
    for name, run in QUERIES.items():
        start = time.time()
        run(spark)
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
