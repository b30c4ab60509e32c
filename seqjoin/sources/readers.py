"""Reads and targets from files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqjoin.operators.numbering import with_row_number
from seqjoin.scratch import materialize
from seqjoin.sources.snappy import blocks_of


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, block, rows) of neighbouring rows of one input split; columns file and block come last but for others of theirs."""
    if not batch.num_rows:
        return
    file, block = (pc.dictionary_encode(batch.column(i)).indices.to_numpy(zero_copy_only=False) for i in (1, 2))
    edges = np.concatenate([[0], np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1, [batch.num_rows]])
    for a, z in zip(edges[:-1], edges[1:]):
        yield batch.column(1)[a].as_py(), batch.column(2)[a].as_py(), batch.slice(a, z - a)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines ended by a line feed, whose carriage return, if it has one, is no part of the line."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def _lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    value = F.regexp_replace("value", "\r$", "").alias("value") if separator == "\n" else F.col("value")
    return spark.read.option("lineSep", separator).text(path).select(value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each four lines; the name is the whole header, marker included.

    Neither marker nor quality is looked at; an incomplete last record is dropped.  A first
    pass counts the lines of every input block and keeps its first and last three, of which
    records across blocks are put together; all other records are taken out of their block
    in place, and no line is shuffled.
    """
    lines = _lines(spark, path)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, first, last = None, 0, [], []

        def row() -> pa.RecordBatch:
            kept = dict(first) | dict(last)
            edge = pa.array([[{"at": k, "value": v} for k, v in sorted(kept.items())]], pa.list_(pa.struct([("at", pa.int64()), ("value", pa.string())])))
            return pa.record_batch([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([n], pa.int64()), edge], ["file", "block", "n", "edge"])

        for batch in batches:
            for file, block, rows in _runs(batch):
                if (file, block) != at:
                    if at:
                        yield row()
                    at, n, first, last = (file, block), 0, [], []
                values = rows.column(0)
                if n < 3:
                    first += [(n + i, values[i].as_py()) for i in range(min(3 - n, len(values)))]
                tail = range(max(0, len(values) - 3), len(values))
                last = [*last, *((n + i, values[i].as_py()) for i in tail)][-3:]
                n += len(values)
        if at:
            yield row()

    blocks = materialize(lines.mapInArrow(survey, "file string, block long, n long, edge array<struct<at: long, value: string>>"), "blocks")
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    edges = blocks.select("file", "ahead", "n", F.inline("edge")).withColumn("line", F.col("ahead") + F.col("at"))
    loose = (F.col("at") < F.pmod(-F.col("ahead"), F.lit(4))) | (F.col("at") >= F.col("n") - F.pmod(F.col("ahead") + F.col("n"), F.lit(4)))
    pick = lambda i: F.max(F.when(F.pmod("line", F.lit(4)) == i, F.col("value")))
    across = edges.where(loose).groupBy("file", F.floor(F.col("line") / 4)).agg(pick(0).alias("name"), pick(1).alias("seq"), pick(3).alias("last"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, skip, left = None, 0, pa.array([], pa.string())
        for batch in batches:
            for file, block, rows in _runs(batch):
                if (file, block) != at:
                    at, skip, left = (file, block), -rows.column(3)[0].as_py() % 4, left[:0]
                values = rows.column(0)
                gone = min(skip, len(values))
                skip -= gone
                values = pa.concat_arrays([left, values[gone:]])
                whole = len(values) // 4 * 4
                left = values[whole:]
                if whole:
                    names, seqs = (values.take(pa.array(np.arange(i, whole, 4))) for i in (0, 1))
                    yield pa.record_batch([names, seqs], ["name", "seq"])

    starts = F.broadcast(blocks.select("file", "block", F.pmod("ahead", F.lit(4)).alias("phase")))  # one row per input block
    inside = lines.join(starts, ["file", "block"]).select("value", "file", "block", "phase").mapInArrow(assemble, "name string, seq string")
    return inside.unionByName(across.where("last IS NOT NULL").select("name", "seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each record, its body lines joined; the name keeps ``>`` and description.

    Records without a body are dropped, as is what stands before the first header.  Records
    are split natively; only a file's first one still has its ``>``, and without it is no record.
    """

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for file, block, rows in _runs(batch):
                values = rows.column(0)
                if (file, block) != at and block == 0 and len(values):
                    head = values[0].as_py()
                    values = values[1:]
                    if head.startswith(">"):
                        values = pa.concat_arrays([pa.array([head[1:]], pa.string()), values])
                at = (file, block)
                yield pa.record_batch([values], ["value"])

    text = F.concat(F.lit(">"), F.regexp_replace("value", "\r", ""))
    records = _lines(spark, path, "\n>").mapInArrow(begun, "value string").select(text.alias("v"))
    rows = records.select(F.substring_index("v", "\n", 1).alias("name"), F.regexp_replace(F.regexp_replace("v", "^[^\n]*", ""), "\n", "").alias("seq"))
    return rows.where("seq <> ''")


def read_text_targets(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of lines ``id<TAB>sequence``; blank lines are skipped, others raise."""
    return _from_lines(read_lines(spark, path))


def _from_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("a target line needs an id, a tab and a sequence: "), F.col("value"))))
    return lines.where(F.trim("value") != "").select(checked.alias("p")).select(F.col("p")[0].alias("name"), F.col("p")[1].alias("seq"))


def read_framed_snappy(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of files in the framed Snappy format, checksums verified.

    The format cannot be split: a file is one task's work and has to be below 2 GB.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rest = b""
                for block in blocks_of(content.as_buffer()):
                    *lines, rest = (rest + block).split(b"\n")
                    if lines:
                        yield pa.record_batch([pa.array([x.rstrip(b"\r").decode() for x in lines], pa.string())], ["value"])
                if rest:
                    yield pa.record_batch([pa.array([rest.decode()], pa.string())], ["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "value string")


def read_targets(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(name, seq) in the file's order: ``fasta`` or ``text``, by suffix if not given, plain, ``.gz`` or ``.sz``."""
    bare = path.lower()
    packed = next((s for s in (".gz", ".sz") if bare.endswith(s)), "")
    bare = bare[: len(bare) - len(packed)]
    fmt = fmt or ("fasta" if bare.endswith(("fasta", ".fa")) else "text")
    if packed == ".sz":
        lines = read_framed_snappy(spark, path)
        if fmt == "text":
            return _from_lines(lines)
        raise ValueError("framed Snappy files are read as text targets only")
    return read_fasta(spark, path) if fmt == "fasta" else read_text_targets(spark, path)


def read_prepared_targets(spark: SparkSession, sequences: str, ids: str) -> DataFrame:
    """(num, name, seq, len) of targets prepared before: a sequence per line, whose place is the target's number, and lines of number, name and length.

    Both may be files or folders of part files, plain, ``.gz`` or (single files) ``.sz``.
    """
    if sequences.lower().endswith(".sz"):
        numbered = with_row_number(read_framed_snappy(spark, sequences), "num")
    else:
        numbered = with_row_number(_lines(spark, sequences), "num", block=F.struct("file", "block")).drop("file", "block")
    lines = read_framed_snappy(spark, ids) if ids.lower().endswith(".sz") else read_lines(spark, ids)
    parts = F.split("value", "\t")
    named = lines.where(F.trim("value") != "").select(parts[0].cast("bigint").alias("num"), parts[1].alias("name"), parts[2].cast("int").alias("len"))
    return numbered.withColumnRenamed("value", "seq").join(named, "num").select("num", "name", "seq", "len")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns of a results file."""
    parts = F.split("value", "\t")
    kinds = [("seq", "string"), ("sub", "string"), ("pos", "int"), ("nmiss", "int"), ("target", "string"), ("target_len", "int"), ("copies", "bigint"), ("names", "string")]
    return read_lines(spark, path).select(*(parts[i].cast(k).alias(n) for i, (n, k) in enumerate(kinds)))
