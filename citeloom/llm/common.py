"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import small_batches  # noqa: F401

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are, whatever the locale."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc32_of_id(column: str = "doc_id") -> Column:
    """Unsigned CRC-32 of an integer id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
