"""Consecutive numbers for rows, without bringing them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqjoin.scratch import materialize


def with_row_number(df: DataFrame, name: str, *, block: Column | None = None) -> DataFrame:
    """``df`` with consecutive BIGINT numbers from 0 in ``name``, in the order of its partitions.

    ``block`` orders stretches of rows, each of which has to lie in one partition without
    gaps (for text files: file and block start).  Rows do not move: one count per stretch is
    aggregated and broadcast.  The rows are written to the shared folder first, with their
    places, so that no second reading can place them differently.
    """
    placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__block", F.shiftright("__at", 33) if block is None else block)
    placed = materialize(placed, "numbered")
    counts = placed.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    ahead = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))  # one row per stretch
    starts = counts.select("__block", "__first", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    numbered = placed.join(F.broadcast(starts), "__block")
    return numbered.withColumn(name, F.col("__ahead") + F.col("__at") - F.col("__first")).drop("__at", "__block", "__first", "__ahead")
