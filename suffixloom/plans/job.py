"""One job from a manifest to a table of output."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.collections import read_base, read_collection, read_manifest
from ..sources.sinks import write_table
from .planner import bwt

# The endings of the two kinds of output.
PLAIN, RUN_LENGTH = ".bwt", ".rl_bwt"


def run_job(spark: SparkSession, manifest: str, output: str | None = None, prefix: int | None = None,
            run_length: bool = False, binary: bool = False, drop_unterminated: bool = False,
            strategy: str | None = None, mode: str = "errorifexists") -> str:
    """Compute the transform of the collection that a manifest names, against the base it names.

    The table goes to ``output``, by default the manifest's path, with the ending of its
    kind; its path is returned.  Documents longer than a piece are taken in pieces.  The scratch tables are dropped at the end."""
    base_path, collection_path = read_manifest(spark, manifest)
    base = read_base(spark, base_path, binary=binary)
    docs = read_collection(spark, collection_path, drop_unterminated=drop_unterminated, binary=binary, pieces=None)
    plan = bwt(docs, base=base, prefix=prefix, strategy=strategy)
    path = (output or manifest) + (RUN_LENGTH if run_length else PLAIN)
    try:
        write_table(plan.rl_bwt() if run_length else plan.bwt(), path, mode)
    finally:
        plan.close()
    return path
