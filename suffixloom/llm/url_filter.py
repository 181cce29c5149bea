"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The longest rule that fits a URL decides it.  URLs that a rule decides are the labelled
ones: from a bounded sample of them (``TRAIN_ROWS``, the rows with the smallest hashes)
boosted trees are trained on length, depth, digit ratio, entropy, parameter counts and
the block rate of the host's suffix; the trees judge every URL no rule fits.

Scale: features are row-wise native expressions, the block rates are one aggregate with
map-side combination over all labelled URLs, and the fitted model is a few kilobytes.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged
by the trees on zero features; a repeated row is judged again; without labelled URLs the
verdict is allow, with one class only it is that class; further columns pass through,
those named as an added column give way.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .common import ascii_lower, bound

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 4, 7
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_digit_ratio", "f_hyphens",
            "f_params", "f_query", "f_fragment", "f_entropy", "f_page", "f_suffix_rate", "f_suffix_seen"]


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def rule_column(rules, host: Column, path: Column, value: int) -> Column:
    """The longest fitting rule (``value`` 1) or its verdict (0), else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    return F.coalesce(*[F.when(_fits(r[1], host, path), F.lit(r[value])) for r in ordered])


def _entropy(text: Column) -> Column:
    """Bits per character of the distribution of characters."""
    def body(chars):
        n = F.size(chars).cast("double")

        def bits(c):
            share = F.size(F.filter(chars, lambda x: x == c)) / n
            return -share * F.log2(share)
        return F.aggregate(F.transform(F.array_distinct(chars), bits), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.length(text) > 0, bound(F.split(text, ""), body)).otherwise(0.0)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def url_parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, PARTS, 1)), F.regexp_extract(url, PARTS, 2)


def url_filter(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``p_block`` (null where a rule decides)."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    added = ("host", "path", "rule", "verdict", "p_block")
    host, path = url_parts(F.col("url"))
    own = [c for c in pages.columns if c not in added]
    parts = (pages.select(F.struct(*own).alias("row"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"),
                          path.alias("path"))
             .withColumn("query", F.regexp_extract("url", QUERY, 1))
             .withColumn("suffix", F.substring_index("host", ".", -1)))
    ruled = parts.withColumns({"rule": rule_column(rules, F.col("host"), F.col("path"), 1),
                               "by_rule": rule_column(rules, F.col("host"), F.col("path"), 0)})
    rates = scratch.save(
        ruled.filter(F.col("rule").isNotNull()).groupBy("suffix").agg(
            F.count("*").alias("seen"), F.sum((F.col("by_rule") == "block").cast("long")).alias("blocked")),
        "suffixes")
    total = rates.agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked")).first()
    seen, blocked = total.seen or 0, total.blocked or 0
    if blocked in (0, seen):  # nothing to learn from
        verdict = "block" if seen and blocked == seen else "allow"
        return ruled.select("row.*", "host", "path", "rule", F.coalesce("by_rule", F.lit(verdict)).alias("verdict"),
                            F.when(F.col("rule").isNull(), F.lit(float(verdict == "block"))).alias("p_block"))
    prior = blocked / seen
    rate = rates.select("suffix", ((F.col("blocked") + 10 * prior) / (F.col("seen") + 10)).alias("f_suffix_rate"),
                        F.log1p(F.col("seen").cast("double")).alias("f_suffix_seen"))
    text, at = F.col("url"), F.col("path")
    digits = _count(text, "0123456789")
    length = F.length(text).cast("double")
    rows = ruled.join(rate, "suffix", "left").withColumns({
        "f_length": length, "f_host": F.length("host").cast("double"), "f_path": F.length("path").cast("double"),
        "f_depth": _count(at, "/"), "f_labels": _count(F.col("host"), "."), "f_digits": digits,
        "f_digit_ratio": digits / F.greatest(length, F.lit(1.0)), "f_hyphens": _count(text, "-_"),
        "f_params": _count(F.col("query"), "="), "f_query": F.length("query").cast("double"),
        "f_fragment": text.contains("#").cast("double"), "f_entropy": _entropy(text),
        "f_page": at.rlike(r"\.[A-Za-z0-9]+$").cast("double"),
        "f_suffix_rate": F.coalesce("f_suffix_rate", F.lit(prior)),
        "f_suffix_seen": F.coalesce("f_suffix_seen", F.lit(0.0))})
    labelled = rows.filter(F.col("rule").isNotNull()).select(
        *FEATURES, (F.col("by_rule") == "block").cast("double").alias("label"), F.xxhash64("url").alias("h"))
    sample = scratch.save(labelled.orderBy("h", *FEATURES).limit(train_rows), "training-rows")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False)
    model = trees.fit(assemble.transform(sample).select("features", "label"))
    judged = model.transform(assemble.transform(rows.filter(F.col("rule").isNull())))
    judged = judged.select("row.*", "host", "path", "rule", vector_to_array("probability")[1].alias("p_block")).withColumn(
        "verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return ruled.filter(F.col("rule").isNotNull()).select(
        "row.*", "host", "path", "rule", F.col("by_rule").alias("verdict"),
        F.lit(None).cast("double").alias("p_block")).unionByName(judged)
