"""From raw targets to numbered, masked targets and their windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqjoin.functions.bases import mask, reverse_complement
from seqjoin.operators.numbering import with_row_number

#: Windows of a target are made a stretch at a time, so no array grows with its length.
STRETCH = 1 << 12


def prepare_targets(targets: DataFrame, rev: bool = False) -> DataFrame:
    """(num, name, seq, len): masked targets, numbered from 0.

    With ``rev`` target i gets number 2i and its reverse complement, named ``<name>_r``,
    2i + 1.  A ``num`` column is kept if there is one; else rows are numbered in their order.
    Rows without a sequence are dropped.
    """
    rows = targets.where(F.col("seq").isNotNull())
    rows = rows if "num" in rows.columns else with_row_number(rows, "num")
    rows = rows.select(F.col("num").cast("bigint").alias("num"), "name", mask(F.col("seq")).alias("seq"))
    if rev:
        both = F.array(
            F.struct((F.col("num") * 2).alias("num"), F.col("name").alias("name"), F.col("seq").alias("seq")),
            F.struct((F.col("num") * 2 + 1).alias("num"), F.concat("name", F.lit("_r")).alias("name"), reverse_complement(F.col("seq")).alias("seq")),
        )
        rows = rows.select(F.inline(both))
    return rows.withColumn("len", F.length("seq"))


def stretches(targets: DataFrame, overlap: int, least: int = 1, most: int = STRETCH) -> DataFrame:
    """(num, base, part): targets cut into stretches that begin every ``most`` bases and run ``overlap`` bases into the next.

    No stretch begins less than ``least`` bases before the target's end.  Cutting is linear in
    the target's length, which it is not in SQL.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, seq in zip(batch.column(0), batch.column(1)):
                text = seq.as_py()
                bases = range(0, len(text) - least + 1, most)
                for some in (bases[i : i + 256] for i in range(0, len(bases), 256)):
                    parts = [text[b : b + most + overlap] for b in some]
                    yield pa.record_batch([pa.array([num.as_py()] * len(parts), pa.int64()), pa.array(some, pa.int32()), pa.array(parts, pa.string())], ["num", "base", "part"])

    length = F.length("seq")
    long = targets.where(length >= most + least).select("num", "seq").mapInArrow(cut, "num long, base int, part string")
    short = targets.where(length.between(least, most + least - 1)).select("num", F.lit(0).alias("base"), F.substring("seq", 1, most + overlap).alias("part"))
    return short.unionByName(long)


def target_windows(targets: DataFrame, width: int) -> DataFrame:
    """(num, p, key): the ``width``-mer at every offset of every target, without the target's text.

    The shuffle of the stretches, a twentieth of the k-mers' size, spreads those of a long
    target over all tasks.  Stretches are cut as bytes, where a substring costs its own
    length, not its offset.
    """
    rows = stretches(targets, width - 1, width).repartition("num", "base").select("num", "base", F.col("part").cast("binary").alias("bytes"))
    rows = rows.select("num", "base", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - width)).alias("i"))
    return rows.select("num", (F.col("base") + F.col("i")).alias("p"), F.substring("bytes", F.col("i") + 1, F.lit(width)).cast("string").alias("key"))
