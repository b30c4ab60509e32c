"""Synthetic reads and targets, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def random_bases(seed: str, number: Column, length: int) -> Column:
    """Bases drawn from md5 of seed, row number and block; two per byte of the digest's text."""
    blocks = [F.md5(F.concat_ws(":", F.lit(seed), number.cast("string"), F.lit(i))) for i in range(-(-length // 32))]
    return F.substring(F.translate(F.concat(*blocks), "0123456789abcdef", "ATGCATGCATGCATGC"), 1, length)


def generate_reads(spark: SparkSession, n: int = 10_000, length: int = 100) -> DataFrame:
    """(name, seq) of ``n`` random reads."""
    return spark.range(n).select(F.concat(F.lit("read_"), F.col("id").cast("string")).alias("name"), random_bases("read", F.col("id"), length).alias("seq"))


def generate_targets(spark: SparkSession, n: int = 10_000, length: int = 1000, read_length: int = 100) -> DataFrame:
    """(num, name, seq): random targets; in the first half, target i holds read i % 10 from base i % 10 on."""
    at = (F.col("id") % 10).cast("int")
    text, read = random_bases("target", F.col("id"), length), random_bases("read", F.col("id") % 10, read_length)
    planted = F.overlay(text, read, at + 1, F.lit(read_length))
    rows = spark.range(n).select("id", F.when(F.col("id") < n // 2, F.substring(planted, 1, length)).otherwise(text).alias("seq"))
    return rows.select(F.col("id").alias("num"), F.concat(F.lit("target_"), F.col("id").cast("string")).alias("name"), "seq")
