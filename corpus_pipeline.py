"""The corpus pipeline: stages over ``documents``, each working on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from suffixloom.llm.common import digest_columns
from suffixloom.llm.decontaminate import decontaminate
from suffixloom.llm.line_dedup import line_dedup
from suffixloom.llm.ngram_join import ngram_join
from suffixloom.llm.pieces import sentencepiece
from suffixloom.llm.quality import quality
from suffixloom.session import Scratch

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with the text of column ``text``."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source",
                     F.length(F.col(text)).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, the others lose their failing lines."""
    return _with_text(quality(docs.select(*DOCUMENT)).filter("kept"), "cleaned")


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share are dropped; a document may be left empty."""
    return _with_text(line_dedup(docs.select(*DOCUMENT)), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least id stays."""
    text = F.coalesce("text", F.lit(""))
    first = ngram_join(docs).filter("first").select(
        F.col("t1").alias("f1"), F.col("t2").alias("f2"), F.col("doc_id").alias("f_id")).distinct()
    rows = docs.select(*DOCUMENT, *digest_columns(text))
    same = (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
    return rows.join(first, same, "left_semi").dropDuplicates(["t1", "t2", "doc_id"]).select(*DOCUMENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).filter("not contaminated").select(*DOCUMENT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids with their byte spans, and digests of the ids and of the text decoded from them."""
    encoded = sentencepiece(docs, PIECE_MODEL, ("n_tokens", "ids", "ids_text", "begins", "ends", "decoded"),
                            keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "begins", "ends",
                          F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", shared_lines), ("n-gram jaccard join", near_duplicates),
          ("benchmark decontamination", benchmark_passages), ("sentencepiece", tokens)]
#: Word sets, tiling and pieces are beyond SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
