"""Results, non-matches and statistics as files."""

from __future__ import annotations

import json
import re
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path, PurePath
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqjoin.config import Config
from seqjoin.functions.bases import first_word, zero_padded
from seqjoin.operators.reads import seq_info
from seqjoin.sources.snappy import HEAD, framed

if TYPE_CHECKING:
    from seqjoin.plans.pipeline import Matched


def beside(results_file: str, tag: str) -> str:
    """``results.txt`` with ``_readstats``: ``results_readstats.txt``."""
    path = PurePath(results_file)
    return str(path.with_name(f"{path.stem}{tag}{path.suffix}"))


def non_match_file(results_file: str) -> str:
    """``results.txt``: ``results.nonmatch.txt.fastq``."""
    path = PurePath(results_file)
    return str(path.with_name(f"{path.stem}.nonmatch{path.suffix}.fastq"))


def _field(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t", " ")


def result_lines(found: DataFrame) -> DataFrame:
    """One tab-separated line per result, in bytewise order of the first six fields."""
    order = [F.col("seq"), F.col("sub"), F.col("pos").cast("string"), F.col("nmiss").cast("string"), F.col("target"), F.col("target_len").cast("string")]
    fields = ["seq", "sub", "pos", "nmiss", "target", "target_len", "copies", "names"]
    return found.orderBy(*order).select(F.concat_ws("\t", *map(_field, fields)).alias("value"))


def non_match_lines(missing: DataFrame, strict: bool = False) -> DataFrame:
    """Four lines per read without a match, as one value, in order of the sequence; ``strict`` keeps the first word of the names."""
    names = first_word(F.col("names")) if strict else F.col("names")
    header = F.concat(names, F.lit("#"), F.col("count").cast("string"))
    quality = F.repeat(F.lit("!"), F.length("seq"))
    return missing.orderBy("seq").select(F.concat_ws("\n", header, "seq", F.lit("+"), quality).alias("value"))


def read_stat_lines(stats: DataFrame, strict: bool = False) -> DataFrame:
    """Names (``strict``: their first word), then the targets with a closing ``;``."""
    names = first_word(_field("names")) if strict else _field("names")
    return stats.orderBy("seq").select(F.concat(names, F.lit("\t"), _field("targets"), F.lit(";")).alias("value"))


def target_stat_lines(stats: DataFrame) -> DataFrame:
    """Target, count and a closing tab."""
    return stats.orderBy("target").select(F.concat(_field("target"), F.lit("\t"), F.col("n").cast("string"), F.lit("\t")).alias("value"))


def unique_read_lines(reads: DataFrame) -> DataFrame:
    """Sequence, copies and names of the distinct reads, in order of the sequence."""
    return reads.orderBy("seq").select(F.concat_ws("\t", "seq", F.col("count").cast("string"), _field("names")).alias("value"))


def target_lines(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, ids) of prepared targets, in order of their number."""
    ordered = targets.orderBy("num")
    ids = F.concat_ws("\t", zero_padded(F.col("num")), _field("name"), F.col("len").cast("string"))
    return ordered.select(F.col("seq").alias("value")), ordered.select(ids.alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """Four lines per read (name, seq), as one value, with a quality of F."""
    return reads.select(F.concat_ws("\n", "name", "seq", F.lit("+"), F.repeat(F.lit("F"), F.length("seq"))).alias("value"))


def fasta_lines(targets: DataFrame, width: int = 60) -> DataFrame:
    """Header and body of each target (name, seq), as one value; body lines of ``width`` bases."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return targets.select(F.concat(F.when(F.startswith("name", F.lit(">")), "").otherwise(">"), F.col("name"), F.lit("\n"), body).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text files whose names follow the order of the lines; compressed if the path ends in ``.gz`` or ``.sz``."""
    if path.endswith(".sz"):
        write_framed_snappy(lines, path)
    else:
        lines.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def write_framed_snappy(lines: DataFrame, path: str) -> None:
    """A folder of framed Snappy files, one per partition, whose names follow the order of the lines.

    The folder is reached as files by every executor.  A part appears under its name only once
    it is whole, so that a repeated task is harmless.
    """
    folder = re.sub(r"^file:(?://)?(?=/)", "", path)
    if re.match(r"\w+:/", folder):
        raise ValueError(f"framed Snappy files are written to folders of the file system only, not to {path}")
    shutil.rmtree(folder, ignore_errors=True)
    Path(folder).mkdir(parents=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        half = Path(folder, f".half-{number:05d}-{uuid.uuid4().hex}")
        with half.open("wb") as out:
            out.write(HEAD)
            for batch in batches:
                text = "".join(f"{x or ''}\n" for x in batch.column(0).to_pylist()).encode()
                out.write(framed(text))
        half.replace(Path(folder, f"part-{number:05d}.sz"))
        yield pa.record_batch([pa.array([number], pa.int32())], ["part"])

    lines.mapInArrow(write, "part int").collect()  # one number per partition


def write_all(found: Matched, cfg: Config) -> None:
    """Results, non-matches and both statistics; with LogDir also the distinct reads, their counts and the configuration."""
    name = cfg.ResultsFileName
    write_lines(result_lines(found.results), name)
    write_lines(non_match_lines(found.non_matches), non_match_file(name))
    write_lines(read_stat_lines(found.read_stats), beside(name, "_readstats"))
    write_lines(target_stat_lines(found.target_stats), beside(name, "_genestats"))
    if cfg.LogDir:
        Path(cfg.LogDir).mkdir(parents=True, exist_ok=True)
        cfg.save(Path(cfg.LogDir) / "config.json")
        Path(cfg.LogDir, "seqinfo.json").write_text(json.dumps(seq_info(found.reads).head().asDict()))
        write_lines(unique_read_lines(found.reads), str(Path(cfg.LogDir) / "reads_sorted.txt"))
