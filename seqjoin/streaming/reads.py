"""Reads that arrive as a stream, matched against fixed targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from seqjoin.config import Config
from seqjoin.operators.targets import target_windows
from seqjoin.plans.pipeline import Matched, match
from seqjoin.scratch import materialize


def match_stream(
    reads: DataFrame, targets: DataFrame, cfg: Config, handle: Callable[[Matched, int], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Match every micro-batch of a stream of (name, seq) with prepared targets.

    ``handle`` gets the batch's matches and its number; writing under that number makes a
    repeated batch harmless.  Copies are counted, and the best matches chosen, within the
    batch: a read's matches depend on nothing but the read, so they are those of a whole run
    as long as MaxMatches does not take hold.  The targets' windows are cut once, before the
    first batch, and kept in the shared folder.
    """
    windows = materialize(target_windows(targets, cfg.WindowWidth), "target_windows")

    def one(batch: DataFrame, number: int) -> None:
        handle(match(batch, targets, cfg, windows), number)

    writer = reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
