"""Expressions and tables that several operators of the subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII white space characters that separate words and frame lines.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t\n\x0b\x0c\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seed of the second half of a 128-bit text digest.
SECOND = 0x5EED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(value) == F.length(value), F.lower(value)).otherwise(
        F.translate(value, UPPER, LOWER))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def digest_columns(text: Column, first: str = "t1", second: str = "t2") -> list[Column]:
    """A 128-bit digest of a text, which stands for the text in joins and groups."""
    return [F.xxhash64(text).alias(first), F.xxhash64(F.lit(SECOND), text).alias(second)]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text without nulls."""
    stripped = strip(text)
    return F.when(F.length(stripped) == 0, F.array().cast("array<string>")).otherwise(
        F.split(stripped, SPACE_RUN, -1))
