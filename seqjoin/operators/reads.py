"""From raw reads to distinct reads and their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqjoin.config import Config
from seqjoin.functions.bases import dinucleotides, mask, shortened_name, shortened_names, truncated

#: So many different names always exceed the 1000 characters kept of a list.
MOST_NAMES = 502


def prepare_reads(reads: DataFrame, cfg: Config) -> DataFrame:
    """(seq, name) of the reads that are long enough as delivered: masked, then cut, names shortened.

    Rows without a sequence (null) are dropped; an empty one stays if the least length is 0.
    """
    return reads.where(F.length("seq") >= cfg.MinReadLength).select(
        truncated(mask(F.col("seq")), cfg.MaxReadLength).alias("seq"), shortened_name(F.col("name")).alias("name")
    )


def unique_reads(prepared: DataFrame) -> DataFrame:
    """(seq, count, names): distinct sequences, how often each was read, names in bytewise order joined by ``;``.

    Null names are counted, not listed.  Of a sequence with millions of reads only as many
    names travel as fit into the list's 1000 characters.
    """
    named = prepared.groupBy("seq", "name").agg(F.count(F.lit(1)).alias("copies"))
    totals = named.groupBy("seq").agg(F.sum("copies").alias("count"))
    first = F.row_number().over(Window.partitionBy("seq").orderBy("name"))
    few = named.where("name IS NOT NULL").withColumn("rank", first).where(F.col("rank") <= MOST_NAMES)
    sorted_names = F.array_sort(F.collect_list(F.struct("name", F.least("copies", F.lit(1002)).cast("int").alias("copies"))))
    repeated = F.flatten(F.transform(sorted_names, lambda x: F.array_repeat(x["name"], x["copies"])))
    listed = few.groupBy("seq").agg(F.array_join(repeated, ";").alias("names"))
    return totals.join(listed, "seq", "left").select("seq", "count", shortened_names(F.coalesce("names", F.lit(""))).alias("names"))


def seq_info(reads: DataFrame) -> DataFrame:
    """One row: NumUnique, NumTotal."""
    return reads.agg(F.count(F.lit(1)).alias("NumUnique"), F.coalesce(F.sum("count"), F.lit(0)).alias("NumTotal"))


def read_windows(reads: DataFrame, cfg: Config) -> DataFrame:
    """(win, q1, key, seq): the windows of each masked read that lie inside it and are complex enough.

    Complexity is tested before the windows become rows.  As a filter on ``key`` the optimizer
    would copy it to the other side of the seed join, and test every window of every target.
    """
    cut = []
    for i, q in enumerate(cfg.Windows):
        key = F.substring("seq", q + 1, cfg.WindowWidth)
        usable = F.length("seq") >= q + cfg.WindowWidth
        if cfg.MinDinuc > 0:
            usable = usable & (dinucleotides(key, masked=True) >= cfg.MinDinuc)
        cut.append(F.when(usable, F.struct(F.lit(i).alias("win"), F.lit(q).alias("q1"), key.alias("key"))))
    return reads.select("seq", F.inline(F.array(*cut))).where("win IS NOT NULL").select("win", "q1", "key", "seq")


def window_counts(windows: DataFrame) -> DataFrame:
    """(q1, n_reads): reads with a usable window, per offset."""
    return windows.groupBy("q1").agg(F.count(F.lit(1)).alias("n_reads"))
