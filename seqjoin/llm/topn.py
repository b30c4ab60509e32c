"""The N best rows of every group, however many rows one group has.

1. Rows are counted per group.  A group of a few rows survives whole: its threshold is its own
   worst score.  Of the others the largest, a bounded number, get a threshold of their own.
2. Edges come from each group's own scores: the least score among rows whose hash ends in j
   zero bits stands at about the 2^j-th place, so a few such minima are edges just beyond the
   N-th place, whatever the scores' kind, scale or distribution.
3. A histogram, exact counts of rows up to each edge, proves which edges hold at least N rows;
   the lowest of them is the threshold.  Rows beyond it are dropped before they are shuffled.
4. The survivors are ranked exactly by score and tie keys.  ``row_number() <= N`` keeps N
   rows per group and task before the shuffle, so even millions of equal scores, or a group
   without a threshold, never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_thresholds(rows: DataFrame, group: str, score: str, ties: Sequence[str], n: int, *, min_rows: int, most_groups: int = 20_000, key_bytes: int = 512) -> DataFrame | None:
    """(g, top): the threshold of each of the largest groups, at most ``most_groups``; None if there are none.

    At least ``n`` rows of the group score ``top`` or less.  Groups of fewer than ``min_rows``
    rows, and such with a key of more than ``key_bytes`` bytes, are left out.
    """
    spark = rows.sparkSession
    g, s = F.col(group).alias("g"), F.col(score).alias("s")
    counted = rows.select(g).groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    large = counted.where((F.col("rows") >= min_rows) & (F.octet_length(F.col("g").cast("string")) <= key_bytes))
    found = large.orderBy(F.desc("rows"), "g").limit(most_groups).select("g").collect()  # at most most_groups * key_bytes bytes
    if not found:
        return None
    keys = F.broadcast(spark.createDataFrame(found, large.select("g").schema))
    of_large = rows.select(g, s, F.xxhash64(score, *ties).alias("h")).join(keys, "g")
    places = [j for j in range(1, 40) if 2**j > n][:: 2][:6]
    edges = of_large.groupBy("g").agg(*(F.min(F.when(F.col("h").bitwiseAND(2**j - 1) == 0, F.col("s"))).alias(f"e{j}") for j in places))
    hist = of_large.join(F.broadcast(edges), "g").groupBy("g", *(f"e{j}" for j in places)).agg(*(F.count_if(F.col("s") <= F.col(f"e{j}")).alias(f"c{j}") for j in places))
    safe = F.least(*(F.when(F.col(f"c{j}") >= n, F.col(f"e{j}")) for j in places))
    tops = hist.select("g", safe.alias("top")).where("top IS NOT NULL")
    return spark.createDataFrame(tops.collect(), tops.schema)  # no more rows than keys


def top_n_per_group(df: DataFrame, group: str, score: str, ties: Sequence[str], n: int = 3, *, min_rows: int | None = None, most_groups: int = 20_000) -> DataFrame:
    """The ``n`` rows of each group with the lowest score; ties by the columns of ``ties``, ascending.

    All columns are kept and ``rank`` (1..n) is added; ``ties`` has to end in a unique column
    for a result that is the same in every run.  Scores may be of any type that has an order.
    Rows whose group or score is null take no part; null tie keys come first.  Groups of fewer
    than ``n`` rows are kept whole; repeated rows compete singly; an empty table gives an empty
    result.  A column named ``rank`` in the input is replaced; other names cannot clash.

    ``min_rows`` (by default 16 times ``n``) and ``most_groups`` decide which groups get a
    threshold, never what the result is: a threshold only drops rows that ``n`` others precede.
    """
    rows = df.drop("rank").where(F.col(group).isNotNull() & F.col(score).isNotNull())
    limits = score_thresholds(rows, group, score, ties, n, min_rows=min_rows or 16 * n, most_groups=most_groups)
    if limits is not None:
        g, top = (_unused(df, x) for x in ("__g", "__top"))
        rows = rows.join(F.broadcast(limits.toDF(g, top)), F.col(group) == F.col(g), "left")  # bounded by most_groups and key_bytes
        rows = rows.where(F.col(top).isNull() | (F.col(score) <= F.col(top))).drop(g, top)
    order = Window.partitionBy(group).orderBy(F.col(score).asc(), *(F.col(c).asc() for c in ties))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name
