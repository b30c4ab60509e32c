"""Results, non-matches and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_target_names(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Matches with the target's name and length in place of its number."""
    return matches.join(targets.select("num", F.col("name").alias("target"), F.col("len").alias("target_len")), "num").drop("num")


def join_read_names(matches: DataFrame, reads: DataFrame) -> DataFrame:
    """Matches with the copies and names of their reads."""
    return matches.join(reads.select("seq", F.col("count").alias("copies"), "names"), "seq")


def results(matches: DataFrame, targets: DataFrame, reads: DataFrame) -> DataFrame:
    """(seq, sub, pos, nmiss, target, target_len, copies, names)."""
    return join_read_names(join_target_names(matches, targets), reads).select("seq", "sub", "pos", "nmiss", "target", "target_len", "copies", "names")


def non_matches(reads: DataFrame, matches: DataFrame) -> DataFrame:
    """The distinct reads without any match."""
    return reads.join(matches.select("seq").distinct(), "seq", "left_anti")


def read_stats(found: DataFrame) -> DataFrame:
    """(seq, names, targets): per read the distinct targets in bytewise order, joined by ``;``."""
    pairs = found.select("seq", "names", "target").distinct()
    return pairs.groupBy("seq", "names").agg(F.array_join(F.array_sort(F.collect_list("target")), ";").alias("targets"))


def target_stats(found: DataFrame) -> DataFrame:
    """(target, n): result rows per target."""
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
