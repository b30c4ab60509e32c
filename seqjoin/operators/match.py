"""The seed join, its verification, caps and the choice of the best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqjoin.config import Config
from seqjoin.functions.bases import dinucleotides, hamming, mismatch_budget
from seqjoin.functions.sketches import may_be_among
from seqjoin.operators.targets import STRETCH, stretches
from seqjoin.scratch import materialize

#: Above this Spark keeps no per-task limit in front of a ranking.
_GROUP_LIMIT = 1000
#: Read windows of up to so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: A key with more than this share of all read windows is joined in so many parts; at most 1024 keys can have it.
HOT_SHARE, SALTS = 1 / 1024, 32


def screen(targets: DataFrame, reads: DataFrame, n_windows: int | None = None) -> DataFrame:
    """The target windows whose key may be the key of some read window, before anything is shuffled.

    A Bloom filter of the read keys, ``n_windows`` rows, is built on the map side and tested
    where the target windows are made.  No window with a read's key is lost; about one in a
    hundred others passes.
    """
    n = reads.count() if n_windows is None else n_windows
    return targets.where(may_be_among(F.col("key"), reads, "key", n))


def seed_join(reads: DataFrame, targets: DataFrame) -> DataFrame:
    """(win, key, seq, num, pos): pairs of read and target windows of one key, where the read does not begin before the target."""
    pairs = reads.join(targets, "key").where(F.col("p") >= F.col("q1"))
    return pairs.select("win", "key", "seq", "num", (F.col("p") - F.col("q1")).alias("pos"))


def salted_seed_join(reads: DataFrame, targets: DataFrame, n_windows: int, hot_share: float = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """The seed join in one shuffle of each side, windows of hot keys spread over ``salts`` parts.

    Hot are keys with more than ``hot_share`` of the read windows (so at most 1 / hot_share
    keys, which are collected); their target windows are sent to every part.
    """
    counts = reads.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, hot_share * n_windows))
    hot = [r.key for r in counts.select("key").collect()]  # at most 1 / hot_share keys
    if not hot:
        return seed_join(reads, targets)
    marked = F.broadcast(reads.sparkSession.createDataFrame([(k, True) for k in hot], "key string, hot boolean"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = reads.join(marked, "key", "left").withColumn("salt", salt).drop("hot")
    right = targets.join(marked, "key", "left").withColumn("salt", F.explode(every)).drop("hot")
    pairs = left.join(right, ["key", "salt"]).where(F.col("p") >= F.col("q1"))
    return pairs.select("win", "key", "seq", "num", (F.col("p") - F.col("q1")).alias("pos"))


def windows_at_most(reads: DataFrame, cfg: Config) -> tuple[int, int]:
    """Bounds on how many windows distinct reads can have, and on their bytes, without cutting them."""
    size = reads.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases")).head()
    return size.n * len(cfg.Windows), (size.bases + size.n * (cfg.WindowWidth + 40)) * len(cfg.Windows)


def candidates(reads: DataFrame, targets: DataFrame, at_most: tuple[int, int] | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """The seed join by the cheapest way for its sizes.

    Read windows of few bytes (a checked bound) are broadcast as they are, and target windows
    are never shuffled.  Of more, their Bloom filter screens the target windows first, and
    only what passes is shuffled, once.  ``at_most`` are bounds on the read windows' number
    and bytes if they are known; otherwise both are counted.
    """
    if at_most is None:
        size = reads.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("key") + F.length("seq") + 40), F.lit(0)).alias("bytes")).head()
        at_most = size.n, size.bytes
    if at_most[1] <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        return seed_join(F.broadcast(reads), targets)
    reads = materialize(reads, "windows")
    n = reads.count()
    return salted_seed_join(reads, screen(targets, reads, n), n)


def fitting(candidates: DataFrame, targets: DataFrame, reach: int, tail: bool = False) -> DataFrame:
    """Candidates with the target's stretch ``sub``, where the whole read fits into the target.

    ``reach`` is the greatest length of a read.  Candidates meet the stretch of the target in
    which they begin, some 4,000 bases and ``reach`` more, so a long target neither travels
    nor stands in one task as a whole.  With ``tail``, also the target's text from the match's
    begin on, up to ``reach`` bases.
    """
    length, at = F.length("seq"), F.col("pos") - F.col("base")
    text = stretches(targets, reach).select("num", "base", F.col("part").cast("binary").alias("__bytes"))
    placed = candidates.withColumn("base", (F.floor(F.col("pos") / STRETCH) * STRETCH).cast("int"))
    rows = placed.join(text, ["num", "base"]).where(at + length <= F.octet_length("__bytes"))
    cut = lambda n: F.substring("__bytes", at + 1, n).cast("string")
    rows = rows.withColumn("sub", cut(length))
    return (rows.withColumn("tail", cut(F.lit(reach))) if tail else rows).drop("__bytes", "base")


def within_budget(pairs: DataFrame, p_match: float) -> DataFrame:
    """Pairs with ``nmiss``, where it is within the budget of the read's length."""
    if p_match == 1:
        return pairs.where(F.col("seq") == F.col("sub")).withColumn("nmiss", F.lit(0))
    counted = pairs.withColumn("nmiss", hamming(F.col("seq"), F.col("sub")))
    return counted.where(F.col("nmiss") <= mismatch_budget(F.length("seq"), p_match))


def seeding_windows(hits: DataFrame, cfg: Config) -> DataFrame:
    """Every verified match once per window (win, q1, key) in which read and target agree."""
    windows = F.array(*(F.struct(F.lit(i).alias("win"), F.lit(q).alias("q1")) for i, q in enumerate(cfg.Windows)))
    rows = hits.select("*", F.inline(windows)).where(F.col("q1") + cfg.WindowWidth <= F.length("seq"))
    key = lambda c: F.substring(c, F.col("q1") + 1, F.lit(cfg.WindowWidth))
    rows = rows.withColumn("key", key("seq")).where(F.col("key") == key("sub"))
    return rows.where(dinucleotides(F.col("key"), masked=True) >= cfg.MinDinuc) if cfg.MinDinuc > 0 else rows


def capped(hits: DataFrame, cfg: Config) -> DataFrame:
    """At most MaxMatches hits per window and key (``first``: one more).

    ``best`` keeps those of fewest mismatches, ties by target, position and read.  ``first``
    keeps those that come first by the target's text left and right of the key, then target,
    position as text, then the read's text left and right.  Groups within the cap, nearly
    all, are never ranked; a small cap is applied in every task before the shuffle; groups
    beyond a large one are sorted across tasks.
    """
    first = cfg.MatchMode == "first"
    most = cfg.MaxMatches + 1 if first else cfg.MaxMatches
    order = [F.col("nmiss"), F.col("num"), F.col("pos"), F.col("seq")]
    if first:
        left = lambda c: F.substring(c, F.lit(1), F.col("q1"))
        right = lambda c: F.substring(c, F.col("q1") + cfg.WindowWidth + 1, F.length(c))
        order = [left("tail"), right("tail"), F.col("num"), (F.col("pos") + F.col("q1")).cast("string"), left("seq"), right("seq")]
    if most <= _GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy("win", "key").orderBy(*order))
        return hits.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
    large = hits.groupBy("win", "key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("win", "key")
    large = materialize(large, "groups")
    if large.isEmpty():
        return hits
    beyond = hits.join(large, ["win", "key"], "left_semi")
    return hits.join(large, ["win", "key"], "left_anti").unionByName(_first_across_tasks(beyond, ["win", "key"], order, most))


def _first_across_tasks(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of every group, however large it is.

    Rows are sorted over all tasks, so that a group lies in consecutive parts of bounded size;
    how many rows of it stand ahead of each part tells which parts are kept whole, dropped or
    cut, and only those are ranked.
    """
    part = rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id())
    part = materialize(part, "sorted")
    counts = part.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).where(F.col("__ahead") < most)
    placed = part.join(counts, [*group, "__part"])
    whole = placed.where(F.col("__ahead") + F.col("__n") <= most)
    cut = placed.where(F.col("__ahead") + F.col("__n") > most)
    rank = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    cut = cut.withColumn("__rank", rank).where(F.col("__ahead") + F.col("__rank") <= most).drop("__rank")
    return whole.unionByName(cut).drop("__part", "__n", "__ahead")


def confirm(reads: DataFrame, windows: DataFrame, targets: DataFrame, cfg: Config, at_most: tuple[int, int] | None = None) -> DataFrame:
    """(seq, sub, pos, nmiss, num): verified matches over all windows, each once.

    ``reads`` are read windows, ``windows`` target windows.  A candidate of several windows
    is verified once.  The cap can only take hold if there are more matches than MaxMatches
    in all; only then are the matches spread over their windows again.  Writes the verified
    matches to the shared folder.
    """
    pairs = candidates(reads, windows, at_most).select("seq", "num", "pos").distinct()
    hits = materialize(within_budget(fitting(pairs, targets, cfg.MaxReadLength, cfg.MatchMode == "first"), cfg.PMatch), "hits")
    if hits.count() > cfg.MaxMatches:
        return materialize(combine(capped(seeding_windows(hits, cfg), cfg)), "matches")
    return hits.select("seq", "sub", "pos", "nmiss", "num")


def combine(hits: DataFrame) -> DataFrame:
    """Matches of all windows, each once."""
    return hits.select("seq", "sub", "pos", "nmiss", "num").dropDuplicates(["seq", "pos", "num"])


def best_matches(hits: DataFrame, tolerance: int) -> DataFrame:
    """Matches with at most ``tolerance`` mismatches more than the read's best one."""
    least = hits.groupBy("seq").agg(F.min("nmiss").alias("__least"))
    return hits.join(least, "seq").where(F.col("nmiss") <= F.col("__least") + tolerance).drop("__least")
