"""python -m seqjoin [FLAGS]: a whole run.

python -m seqjoin prep [-rev] FILE: prepare targets only, to ``targets_FILE`` and ``ids_FILE`` beside it, compressed as FILE is.
python -m seqjoin generate [--NumRead=N] [--ReadLen=N] [--NumGene=N] [--GeneLen=N] [--Dir=FOLDER]: synthetic reads and targets.
"""

import argparse
import sys
from pathlib import PurePath

from pyspark.sql import SparkSession

from seqjoin.config import from_args
from seqjoin.operators.targets import prepare_targets
from seqjoin.plans.pipeline import run
from seqjoin.plans.synthetic import generate_reads, generate_targets
from seqjoin.scratch import release
from seqjoin.sources.readers import read_targets
from seqjoin.sources.writers import fastq_lines, target_lines, write_lines


def prepare(spark: SparkSession, path: str, rev: bool) -> None:
    sequences, ids = target_lines(prepare_targets(read_targets(spark, path), rev))
    file = PurePath(path)
    write_lines(sequences, str(file.with_name(f"targets_{file.name}")))
    write_lines(ids, str(file.with_name(f"ids_{file.name}")))


def generate(spark: SparkSession, argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="seqjoin generate", allow_abbrev=False)
    for name, default in (("NumRead", 10_000), ("ReadLen", 100), ("NumGene", 10_000), ("GeneLen", 1000)):
        parser.add_argument(f"--{name}", f"-{name}", type=int, default=default)
    parser.add_argument("--Dir", "-Dir", default=".")
    a = parser.parse_args(argv)
    write_lines(fastq_lines(generate_reads(spark, a.NumRead, a.ReadLen)), f"{a.Dir}/reads.fastq")
    write_lines(generate_targets(spark, a.NumGene, a.GeneLen, a.ReadLen).selectExpr("concat(name, '\\t', seq) AS value"), f"{a.Dir}/genes.txt")


def main(argv: list[str]) -> None:
    rev = any(a in ("-rev", "--rev") for a in argv)
    rest = [a for a in argv if a not in ("-rev", "--rev")]
    builder = SparkSession.builder.appName("seqjoin")
    cfg = from_args(rest) if rest[:1] not in (["prep"], ["generate"]) else None
    if cfg and cfg.TempDir:
        builder = builder.config("spark.checkpoint.dir", cfg.TempDir)
    spark = builder.getOrCreate()
    try:
        if cfg:
            run(spark, cfg, rev)
        elif rest[0] == "prep":
            prepare(spark, rest[-1], rev)
        else:
            generate(spark, rest[1:])
    finally:
        if not (cfg and cfg.NoCleanTemp):
            release(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
