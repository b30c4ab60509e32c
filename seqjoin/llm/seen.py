"""Has this key been seen before?  A log-structured store of keys, probed by merge join.

Keys come in batches.  Of every batch the keys that no run holds yet become one immutable
run: a folder with a file per bucket, sorted by (hash, key), each file in blocks (row groups)
with the least and greatest hash as fences.  Runs live on levels; ``fanout`` runs of one level
are merged into one run of the next, so that n batches leave O(log n) runs, and the files of
merged runs are deleted.  A manifest in the store's folder, one small file per version, names
the runs; any session opens the store by that folder.

A probe shuffles the distinct keys of its batch once, by the runs' own bucketing, and merge
joins them with one run after the other.  A run is neither shuffled nor sorted again, and
blocks between whose fences no probed hash lies are not read.  A hash that is found counts as
seen only if the whole key is equal.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqjoin.scratch import new_path

#: Hash ranges told apart when a probe is fenced; a bound on what the driver sees of it.
FENCES = 4096
#: Above so many separate ranges neighbours are joined, so that the pushed filter stays short.
MOST_RANGES = 128


@dataclass(frozen=True)
class Run:
    """One immutable sorted run."""

    level: int
    path: str
    rows: int


def sequence_key(seq: Column, length: int = 100) -> Column:
    """The key of a read: foreign characters masked by X, then cut; null for null and empty."""
    return F.when(seq != "", F.substring(F.regexp_replace(seq, "[^ATGC]", "X"), 1, length))


@contextmanager
def _bucketwise(spark: SparkSession, buckets: int) -> Iterator[None]:
    """While this holds, shuffles have as many partitions as runs have buckets, and Spark relies on the order of bucket files (one per bucket, as runs have them)."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.shuffle.partitions": str(buckets)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class SeenStore:
    """Keys seen so far, each with the number under which it first came, as levelled sorted runs.

    ``path`` is a folder every executor reaches; a store that is there already is opened, with
    the buckets it was made with.  One writer at a time.  ``block_rows`` is the most rows
    between two fences.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, buckets: int | None = None, fanout: int = 4, block_rows: int = 1 << 20):
        self.spark, self.fanout, self.block_rows = spark, fanout, block_rows
        self.path = (path or new_path(spark, "seen")).rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self._tables = 0, [], {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._open()

    # Manifest

    def _open(self) -> None:
        folder = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = [int(n.split("-")[1].split(".")[0]) for n in names if n.startswith("manifest-")]
        if versions:
            self.version = max(versions)
            kept = json.loads("".join(r.value for r in self.spark.read.text(self._manifest(self.version)).collect()))
            self.buckets, self.runs = kept["buckets"], [Run(**r) for r in kept["runs"]]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest-{version:08d}.json"

    def _commit(self, runs: list[Run]) -> None:
        """Make ``runs`` the store's runs: a new manifest appears whole, then what only the old one named goes."""
        text = json.dumps({"buckets": self.buckets, "runs": [asdict(r) for r in runs]})
        half = self._path(f"{self.path}/half-{uuid.uuid4().hex}")
        out = self._fs.create(half)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(half, self._path(self._manifest(self.version + 1))):
            raise RuntimeError("another writer has changed the store")
        old, before = [r for r in self.runs if r not in runs], self._manifest(self.version)
        self.version, self.runs = self.version + 1, runs
        for r in old:
            if name := self._tables.pop(r.path, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._fs.delete(self._path(r.path), True)
        self._fs.delete(self._path(before), False)

    # Runs

    def _table(self, run: Run) -> DataFrame:
        """A run with its bucketing and order, under a name of this session."""
        if run.path not in self._tables:
            name = f"seen_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {name} (h BIGINT, key STRING, first BIGINT) USING parquet LOCATION '{run.path}' CLUSTERED BY (h, key) SORTED BY (h, key) INTO {self.buckets} BUCKETS"
            )
            self._tables[run.path] = name
        return self.spark.table(self._tables[run.path])

    def _write(self, rows: DataFrame, level: int) -> Run:
        """A new run of (h, key, first); ``rows`` are grouped by (h, key)."""
        name, path = f"seen_{uuid.uuid4().hex}", f"{self.path}/run-{uuid.uuid4().hex}"
        with _bucketwise(self.spark, self.buckets):
            rows.write.bucketBy(self.buckets, "h", "key").sortBy("h", "key").option("path", path).option(
                "parquet.block.row.count.limit", self.block_rows
            ).saveAsTable(name)
        self._tables[path] = name
        return Run(level, path, self.spark.table(name).count())

    def fenced(self, keys: DataFrame, run: Run) -> DataFrame:
        """The run without the blocks that no hash of ``keys`` (a column h) can be in.

        The hashes' leading bits, at most FENCES values, are looked at; a probe that has most
        of them reads the whole run.
        """
        table, bits = self._table(run), FENCES.bit_length() - 1
        if run.rows <= self.block_rows:
            return table
        lead = sorted(r[0] for r in keys.select(F.shiftright("h", 64 - bits)).distinct().collect())  # at most FENCES rows
        if 2 * len(lead) > FENCES:
            return table
        ranges = [[a, a] for a in lead[:1]]
        for a in lead[1:]:
            ranges.append([a, a]) if a > ranges[-1][1] + 1 else ranges[-1].__setitem__(1, a)
        while len(ranges) > MOST_RANGES:  # join the nearest neighbours
            gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])[: len(ranges) - MOST_RANGES]
            for i in sorted(gaps, reverse=True):
                ranges[i - 1][1] = max(ranges[i - 1][1], ranges.pop(i)[1])
        inside, step = F.lit(False), 64 - bits
        for a, b in ranges:
            inside = inside | F.col("h").between(a << step, ((b + 1) << step) - 1)
        return table.where(inside)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (with columns h and key) whose whole key is in no run."""
        lead = keys.select("h")
        for r in sorted(self.runs, key=lambda r: -r.rows):
            keys = keys.join(self.fenced(lead, r).select("h", "key"), ["h", "key"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Store what is new among ``keys``: (key[, number]); null keys are left out, of repeated ones the least number stays."""
        number = F.col("no") if len(keys.columns) > 1 else F.lit(None).cast("bigint")
        named = keys.toDF(*["key", "no"][: len(keys.columns)]).where("key IS NOT NULL").select(F.xxhash64("key").alias("h"), "key", number.cast("bigint").alias("no"))
        distinct = named.groupBy("h", "key").agg(F.min("no").alias("first"))
        self._commit([*self.runs, self._write(self.unseen(distinct), 0)])
        self.compact()

    def compact(self) -> None:
        """Merge every level that has ``fanout`` runs or more into one run of the next level."""
        level = 0
        while level <= max((r.level for r in self.runs), default=-1):
            full = [r for r in self.runs if r.level == level]
            if len(full) >= self.fanout:
                rows = self._all(full).groupBy("h", "key").agg(F.min("first").alias("first"))
                self._commit([r for r in self.runs if r.level != level] + [self._write(rows, level + 1)])
            level += 1

    def _all(self, runs: list[Run]) -> DataFrame:
        found = self.spark.createDataFrame([], "h long, key string, first long")
        for i, r in enumerate(runs):
            found = found.unionByName(self._table(r)) if i else self._table(r)
        return found

    def keys(self) -> DataFrame:
        """(h, key, first) of all runs, every key once; ``first`` is null for keys stored without a number."""
        return self._all(self.runs)

    def drop(self) -> None:
        """Delete the store."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()
        self._fs.delete(self._path(self.path), True)


def seen_reads(reads: DataFrame, order: str, key: Column, store: SeenStore, batches: int = 4) -> DataFrame:
    """``order`` of the rows whose key is in the store or in a row of smaller ``order``; the store takes the new keys in.

    ``order`` is a unique integer.  The rows come to the store in ``batches`` stretches of it,
    one after the other; of each the new keys, with their first row, become a run.  All rows
    but those first ones were seen, so the first ones are taken out by their number, and no
    row travels by its key, however hot that is.  Rows without a key (null) are not answered
    and left out.  Repeated rows with another number are seen; an empty store or table is fine.
    """
    arrive(reads, order, key, store, batches)
    new = store.keys().where("first IS NOT NULL").select("first")
    return reads.where(key.isNotNull()).select(order).join(new, F.col(order) == F.col("first"), "left_anti")


def arrive(reads: DataFrame, order: str, key: Column, store: SeenStore, batches: int = 4) -> None:
    """Add the keys of ``reads`` to the store, in ``batches`` stretches of ``order``."""
    ends = reads.agg(F.min(order).alias("a"), F.max(order).alias("z")).head()
    if ends.a is None:
        return
    cuts = [ends.a + (ends.z + 1 - ends.a) * i // batches for i in range(batches + 1)]
    for a, z in zip(cuts, cuts[1:]):
        if a < z:
            store.add(reads.where((F.col(order) >= a) & (F.col(order) < z)).select(key.alias("key"), F.col(order).alias("no")))


def _counts(**columns: DataFrame) -> DataFrame:
    """One row with the first column's value of each one-row table."""
    names = list(columns)
    rows = None
    for name, df in columns.items():
        one = df.select(*(df[df.columns[0]].cast("long").alias(n) if n == name else F.lit(0).cast("long").alias(n) for n in names))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))


def answer_rates(reads: DataFrame, order: str, key: Column, old: DataFrame, store: SeenStore) -> DataFrame:
    """(n_answers, n_seen, n_wrong, wrong_rate): the store's answers against an exact count over all rows.

    ``store`` has taken in ``old`` (one column of keys) and then ``reads``.  A read is answered
    wrongly if the store has it as its key's first row and it is not, or the other way round.
    """
    keyed = reads.select(key.alias("key"), F.col(order).alias("no")).where("key IS NOT NULL")
    known = old.select(old[old.columns[0]].alias("key"), F.lit(None).cast("long").alias("no"), F.lit(True).alias("known")).where("key IS NOT NULL")
    both = keyed.select("key", "no", F.lit(False).alias("known")).unionByName(known)
    exact = both.groupBy("key").agg(F.min("no").alias("first"), F.bool_or("known").alias("known")).where("NOT known").select("first", F.lit(1).alias("side"))
    told = store.keys().where("first IS NOT NULL").select("first", F.lit(2).alias("side"))
    wrong = exact.unionByName(told).groupBy("first").agg(F.sum("side").alias("sides")).where("sides <> 3").agg(F.count(F.lit(1)))
    row = _counts(n_answers=keyed.agg(F.count(F.lit(1))), n_first=told.agg(F.count(F.lit(1))), n_wrong=wrong)
    rate = F.when(F.col("n_answers") > 0, F.col("n_wrong") / F.col("n_answers")).otherwise(F.lit(0.0))
    return row.select("n_answers", (F.col("n_answers") - F.col("n_first")).alias("n_seen"), "n_wrong", rate.alias("wrong_rate"))


def unverified_rates(reads: DataFrame, key: Column, store: SeenStore, hash_bits: int = 32) -> DataFrame:
    """(n_answers, n_wrong, wrong_rate): what would be answered wrongly if only ``hash_bits`` of the hash were compared.

    The store has taken in ``reads``.  Wrong are the new keys that are not the earliest key of
    their hash value.
    """
    per_hash = store.keys().groupBy(F.shiftrightunsigned("h", 64 - hash_bits).alias("cut")).agg(
        F.count("first").alias("n_new"), F.max(F.col("first").isNull().cast("int")).alias("stored")
    )
    wrong = per_hash.agg(F.sum(F.when(F.col("n_new") > 0, F.col("n_new") - 1 + F.col("stored")).otherwise(0)))
    row = _counts(n_answers=reads.agg(F.count(key)), n_wrong=wrong)
    return row.withColumn("wrong_rate", F.when(F.col("n_answers") > 0, F.col("n_wrong") / F.col("n_answers")).otherwise(F.lit(0.0)))
