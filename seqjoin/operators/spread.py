"""Spreading few input splits over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    Meant in front of work in Python that costs far more than moving the rows: an input that
    comes in fewer splits than there are cores (so of a bounded size) is dealt out evenly; a
    larger one, or one that has a shuffle behind it, is left as it is.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # counting its partitions would compute it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
