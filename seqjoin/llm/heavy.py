"""The most frequent values of a column in bounded memory.

Every row's value is hashed to 64 bits.  For a few lengths of hash prefix a count-sketch
(``depth`` rows of ``width`` signed counters) is filled by each task and added up; the
shortest prefixes are counted exactly.  From the top, each heavy prefix is extended by all
continuations to the next length and only those whose estimate is high enough are kept, so
that a few hundred prefixes lead to the candidates.  A second scan counts the candidates
exactly.  Memory per task and on the driver depends on depth, width and the threshold only,
not on rows or distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the hash prefixes, in bits; the first is counted without a sketch.
LEVELS = (12, 20, 28, 36, 44)
_MULTIPLIERS = tuple(int(x) | 1 for x in np.random.default_rng(20240229).integers(1, 2**63, 64))


def _cells(prefix: np.ndarray, level: int, row: int, width_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each prefix in one row of one level's sketch."""
    k = level * 16 + row * 2
    with np.errstate(over="ignore"):
        x = (prefix + np.uint64(k + 1)) * np.uint64(_MULTIPLIERS[k % 64])
        x ^= x >> np.uint64(29)
        x *= np.uint64(_MULTIPLIERS[(k + 1) % 64])
        x ^= x >> np.uint64(32)
    sign = 1 - 2 * (x & np.uint64(1)).astype(np.int64)
    return (x >> np.uint64(64 - width_bits)).astype(np.int64), sign


class PrefixSketch:
    """Count-sketches of one multiset of 64-bit hashes, one per prefix length."""

    def __init__(self, depth: int = 5, width_bits: int = 13, levels: tuple[int, ...] = LEVELS):
        self.depth, self.width_bits, self.levels = depth, width_bits, levels
        self.first = np.zeros(1 << levels[0], np.int64)
        self.tables = np.zeros((len(levels) - 1, depth, 1 << width_bits), np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Count every hash once."""
        values, counts = np.unique(hashes.astype(np.uint64, copy=False), return_counts=True)
        self.first += np.bincount((values >> np.uint64(64 - self.levels[0])).astype(np.int64), counts, len(self.first)).astype(np.int64)
        for i, bits in enumerate(self.levels[1:]):
            prefix = values >> np.uint64(64 - bits)
            for row in range(self.depth):
                cell, sign = _cells(prefix, i, row, self.width_bits)
                self.tables[i, row] += np.bincount(cell, sign * counts, 1 << self.width_bits).astype(np.int64)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """The counters as numbered rows, which add up over sketches."""
        yield 0, self.first
        for i, table in enumerate(self.tables):
            for row in range(self.depth):
                yield 1 + i * self.depth + row, table[row]

    def put(self, part: int, values: np.ndarray) -> None:
        if part == 0:
            self.first = values
        else:
            self.tables[(part - 1) // self.depth, (part - 1) % self.depth] = values

    def estimate(self, prefixes: np.ndarray, level: int) -> np.ndarray:
        """Estimated rows under each prefix of length ``levels[level]``."""
        if level == 0:
            return self.first[prefixes.astype(np.int64)]
        rows = []
        for row in range(self.depth):
            cell, sign = _cells(prefixes, level - 1, row, self.width_bits)
            rows.append(self.tables[level - 1, row][cell] * sign)
        return np.median(np.array(rows), axis=0)

    def heavy(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes of the last length, and their estimates, found by descending those of at least ``least`` rows."""
        found = np.flatnonzero(self.first >= least).astype(np.uint64)
        for level in range(1, len(self.levels)):
            step = self.levels[level] - self.levels[level - 1]
            found = ((found[:, None] << np.uint64(step)) | np.arange(1 << step, dtype=np.uint64)).ravel()
            found = found[self.estimate(found, level) >= least]
        return found, self.estimate(found, len(self.levels) - 1)


def sketch_hashes(hashes: DataFrame, depth: int, width_bits: int, unpack: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]]) -> tuple[PrefixSketch, int]:
    """The sketch of all hashes that ``unpack`` draws from the rows of ``hashes``, and their number.

    One pass.  Every task sends its counter rows compressed; they are added up in groups of
    some two hundred tasks first, so that no task has to add up those of all others.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = PrefixSketch(depth, width_bits), 0
        for some in unpack(batches):
            sketch.add(some)
            n += len(some)
        if n:
            yield packed([(-1, np.array([n], np.int64)), *sketch.parts()])

    def packed(rows: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        codec, rows = pa.Codec("zstd"), list(rows)
        blobs = [codec.compress(v.tobytes(), asbytes=True) for _, v in rows]
        return pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([len(v) for _, v in rows], pa.int32()), pa.array(blobs, pa.binary())], ["part", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for part, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = np.frombuffer(codec.decompress(blob.as_buffer(), 8 * n, asbytes=True), np.int64)
                sums[part] = sums[part] + values if part in sums else values
        if sums:
            yield packed(sums.items())

    schema = "part int, n int, counts binary"
    tables = hashes.mapInArrow(fill, schema)
    tasks = hashes.rdd.getNumPartitions()
    if tasks > 256:
        group = F.floor(F.spark_partition_id() / 200).alias("g")
        tables = tables.select("*", group).repartition(-(-tasks // 50), "part", "g").drop("g").mapInArrow(add, schema)
    sketch, total, codec = PrefixSketch(depth, width_bits), 0, pa.Codec("zstd")
    merged = tables.repartition(min(8, 2 + (len(LEVELS) - 1) * depth), "part").mapInArrow(add, schema)
    for row in merged.collect():  # depth x levels rows of 2**width_bits counters, whatever the input
        values = np.frombuffer(codec.decompress(row.counts, 8 * row.n, asbytes=True), np.int64)
        if row.part < 0:
            total = int(values[0])
        else:
            sketch.put(row.part, values)
    return sketch, total


def build_sketch(df: DataFrame, column: str, depth: int = 5, width_bits: int = 13) -> PrefixSketch:
    """The sketch of all non-null values of ``column``."""
    hashes = df.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    return sketch_hashes(hashes, depth, width_bits, lambda batches: (b.column(0).to_numpy().view(np.uint64) for b in batches if b.num_rows))[0]


def frequent_values(df: DataFrame, column: str, share: float, *, slack: float = 0.5, depth: int = 5, width_bits: int = 13) -> DataFrame:
    """(value, estimate, n_rows) of every value in at least ``share`` of all rows of ``df``.

    Null and empty values count towards the total but are never reported.  Candidates are
    prefixes whose estimate reaches ``slack`` of the threshold; at most 4 / (share * slack)
    of them are looked up (more cannot be that heavy but by a bad draw; the sketch is then made
    again, four times as wide).  The
    second scan counts them exactly, so no reported value is wrong; a missed one needs the
    median of ``depth`` counters to be off by (1 - slack) of the threshold.  Ties need no
    rule; an empty table gives an empty result.
    """
    spark = df.sparkSession
    schema = f"`{column}` string, estimate long, n_rows long"
    total = df.count()
    if not total:
        return spark.createDataFrame([], schema)
    values = df.select(F.col(column).cast("string").alias("v")).where("v <> ''")
    while True:
        prefixes, estimates = build_sketch(values, "v", depth, width_bits).heavy(share * total * slack)
        if len(prefixes) <= 4 / (share * slack):
            break
        width_bits += 2  # a bad draw, or a sketch too narrow for this share: once more, wider
    if not len(prefixes):
        return spark.createDataFrame([], schema)
    shift = 64 - LEVELS[-1]
    wanted = spark.createDataFrame([(int(p), int(e)) for p, e in zip(prefixes, estimates)], "prefix long, estimate long")
    return (
        values.withColumn("prefix", F.shiftrightunsigned(F.xxhash64("v"), shift))
        .join(F.broadcast(wanted), "prefix")  # at most 4 / (share * slack) rows
        .groupBy("v")
        .agg(F.first("estimate").alias("estimate"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") >= F.lit(float(share)) * F.lit(total))
        .select(F.col("v").alias(column), "estimate", "n_rows")
    )
