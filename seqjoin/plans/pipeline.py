"""The whole run, from reads and targets to results."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from seqjoin.config import Config
from seqjoin.operators.match import best_matches, confirm, windows_at_most
from seqjoin.operators.reads import prepare_reads, read_windows, seq_info, unique_reads, window_counts
from seqjoin.operators.report import join_target_names, non_matches, read_stats, results, target_stats
from seqjoin.operators.targets import prepare_targets, target_windows
from seqjoin.scratch import materialize
from seqjoin.sources import readers, writers


@dataclass(frozen=True)
class Matched:
    """What a run gives.  Reads and matches stand in the shared folder; everything derived from them is lazy."""

    reads: DataFrame
    best: DataFrame
    targets: DataFrame
    stored: DataFrame | None = None

    @property
    def results(self) -> DataFrame:
        return results(self.best, self.targets, self.reads) if self.stored is None else self.stored

    @property
    def non_matches(self) -> DataFrame:
        return non_matches(self.reads, self.best)

    @property
    def read_stats(self) -> DataFrame:
        return read_stats(self.results)

    @property
    def target_stats(self) -> DataFrame:
        return target_stats(join_target_names(self.best, self.targets))


def match(reads: DataFrame, targets: DataFrame, cfg: Config, windows: DataFrame | None = None) -> Matched:
    """Match raw reads (name, seq) with prepared targets (num, name, seq, len).

    The distinct reads and the verified matches are computed at once and written to the
    shared folder.  ``windows`` are the targets' windows where they are kept.
    """
    unique = materialize(unique_reads(prepare_reads(reads, cfg)), "reads")
    windows = target_windows(targets, cfg.WindowWidth) if windows is None else windows
    hits = confirm(read_windows(unique, cfg), windows, targets, cfg, windows_at_most(unique, cfg))
    return Matched(unique, best_matches(hits, cfg.MMTol), targets)


def run(spark: SparkSession, cfg: Config, rev: bool = False) -> Matched:
    """Read the files the configuration names and write all outputs beside ResultsFileName.

    With GeneIdFileName the targets are prepared ones (sequences, ids); else they are prepared
    now.  Stages are logged, with LogDir also to ``run.log`` there.  Raises if no read is
    usable: none long enough, or none with a window that is complex enough.
    """
    cfg.check()
    log = _logger(cfg)
    log.info("reading %s and %s", cfg.ReadFileName, cfg.GeneFileName)
    reads = readers.read_fastq(spark, cfg.ReadFileName)
    if cfg.GeneIdFileName:
        targets = materialize(readers.read_prepared_targets(spark, cfg.GeneFileName, cfg.GeneIdFileName), "targets")
    else:
        targets = materialize(prepare_targets(readers.read_targets(spark, cfg.GeneFileName), rev), "targets")
    made = match(reads, targets, cfg)
    counted = seq_info(made.reads).head()
    log.info("%d reads used (%d distinct), %d skipped", counted.NumTotal, counted.NumUnique, reads.count() - counted.NumTotal)
    per_window = {r.q1: r.n_reads for r in window_counts(read_windows(made.reads, cfg)).collect()}  # a row per window
    for q in cfg.Windows:
        log.info("window at %d: %d distinct reads", q, per_window.get(q, 0))
    if not per_window:
        raise ValueError("no read has a usable window: all are too short or not complex enough")
    found = replace(made, stored=materialize(made.results, "results"))
    log.info("%d results", found.results.count())
    writers.write_all(found, cfg)
    log.info("written beside %s", cfg.ResultsFileName)
    return found


def _logger(cfg: Config) -> logging.Logger:
    log = logging.getLogger("seqjoin")
    log.setLevel(logging.INFO)
    for old in [h for h in log.handlers if isinstance(h, logging.FileHandler)]:
        log.removeHandler(old)
        old.close()
    if cfg.LogDir:
        Path(cfg.LogDir).mkdir(parents=True, exist_ok=True)
        handler = logging.FileHandler(Path(cfg.LogDir) / "run.log")
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
    return log
