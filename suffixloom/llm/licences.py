"""Licence scan by canonical digest.

A text is brought to a canonical form - no copyright lines, small letters, punctuation
and white space as single spaces, one spelling for equivalent ones - and its digest is
joined with the digests of known licences, whose texts pass through the same
expression.  Each line is looked up the same way among known one-line notices.

Scale: a row-wise native expression and a join with a table of fixed size (the texts of
``licence_texts``), which Spark broadcasts below its own size limit.  Lines that are no
notice leave at that join, before anything is exchanged; documents without one never
meet the grouping of notices.

Defined cases: a null, empty or wordless text has an empty canonical form and no
licence; a repeated row is scanned again; further columns pass through, those named as
an added column give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import Scratch
from .common import bound, digest_columns
from .licence_texts import LICENCES, NOTICES, SPELLINGS

#: A line that only names the holder of rights.
COPYRIGHT_LINE = r"(?m)^[ \t\r*#/;-]*(copyright([ :]|$)|\(c\)|©|all rights reserved)[^\n]*$"
#: In the canonical form of every known notice; what may become it contains the shorter stem.
NOTICE_STEM, RAW_STEM = "licens", "licen"
#: Texts without any of the spellings skip their replacement.
ANY_SPELLING = " (" + "|".join(found for found, _ in SPELLINGS) + ") "
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text without nulls."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), NOT_WORD, " ")
    framed = F.concat(F.lit(" "), plain, F.lit(" "))
    one = lambda t: reduce(lambda x, s: F.replace(x, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), SPELLINGS, t)
    return F.btrim(bound(framed, lambda t: F.when(t.rlike(ANY_SPELLING), one(t)).otherwise(t)))


def known(spark: SparkSession, texts) -> DataFrame:
    """``digest, license``: one row per canonical form of the known texts."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts])
    return (spark.range(1).select(F.explode(rows).alias("k")).select("k.license", F.sha2(canonical(F.col("k.text")), 256)
            .alias("digest")).groupBy("digest").agg(F.min("license").alias("license")))


def licence_scan(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``canonical_sha256``, ``license`` (of the entire text, else null) and
    ``notices`` (sorted ids of the notices on its lines)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    added = ("canonical_sha256", "license", "notices")
    own = [c for c in docs.columns if c not in added]
    text = F.coalesce("text", F.lit(""))
    assert all(NOTICE_STEM in t.lower() for _, t in NOTICES)
    lines = docs.select(*digest_columns(text), F.explode(F.split(text, "\n", -1)).alias("line")).filter(
        F.lower("line").contains(RAW_STEM))
    noticed = scratch.save(
        lines.withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(known(spark, NOTICES), "digest")
        .groupBy("t1", "t2").agg(F.array_sort(F.collect_set("license")).alias("notices")), "notices")
    scanned = docs.select(F.struct(*own).alias("row"), *digest_columns(text),
                          F.sha2(canonical(text), 256).alias("canonical_sha256"))
    entire = known(spark, LICENCES + NOTICES).withColumnRenamed("digest", "canonical_sha256")
    return (scanned.join(entire, "canonical_sha256", "left").join(noticed, ["t1", "t2"], "left")
            .select("row.*", "canonical_sha256", "license",
                    F.coalesce("notices", F.array().cast("array<string>")).alias("notices")))
