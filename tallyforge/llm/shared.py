"""Paths, checkpoints and columns that several text operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.scratch import scratch, shared_dir, written  # noqa: F401  (the operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def fraction(hashed):
    """A 64-bit hash as a number from 0 up to 1, by its 53 leading bits: what a sample's share is compared with."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
