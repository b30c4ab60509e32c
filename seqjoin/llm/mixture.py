"""Mixing sources to target shares by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow
over the few patterns and sources decides how many tokens of each pattern serve each source:
using a pattern's tokens a k-th time costs k, so repetition is spread before it is stacked.
Where a source cannot fill its share, the others are raised in proportion to their goals,
each up to what it can give, so that the mixture still has its total size.  Documents are
then chosen by position on a seeded, size-weighted tape per pattern, found by distributed
prefix sums; shares are met to within one document per source and pattern.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqjoin.scratch import materialize

#: So many membership patterns, the largest, are routed as they are.
MOST_PATTERNS = 4096


@dataclass(frozen=True)
class Goal:
    source: str
    share: float
    max_repeats: int


class Flow:
    """Min-cost flow by successive cheapest paths on a small graph of integer capacities."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def push(self, a: int, b: int) -> int:
        """Send as much as possible as cheaply as possible from ``a`` to ``b``; how much."""
        sent = 0
        while True:
            dist: dict[int, int] = {a: 0}
            via: dict[int, int] = {}
            queue = [a]
            while queue:
                later: list[int] = []
                for x in queue:
                    for e in self.out[x]:
                        y = self.to[e]
                        if self.room[e] and dist[x] + self.cost[e] < dist.get(y, 1 << 60):
                            dist[y], via[y] = dist[x] + self.cost[e], e
                            later.append(y)
                queue = list(dict.fromkeys(later))
            if b not in dist:
                return sent
            path, x = [], b
            while x != a:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            sent += step


def route(patterns: dict[frozenset[str], int], goals: Sequence[Goal], total: int) -> dict[tuple[frozenset[str], str], int]:
    """Tokens of each pattern used for each source."""

    def solve(scale: float) -> tuple[int, dict[tuple[frozenset[str], str], int]]:
        names = [g.source for g in goals]
        sets = [p for p in patterns if p & set(names) and patterns[p]]
        flow = Flow(2 + len(sets) + len(goals))
        end = 1 + len(sets) + len(goals)
        arcs = {}
        for i, p in enumerate(sets):
            mine = [g for g in goals if g.source in p]
            for k in range(max(g.max_repeats for g in mine)):
                flow.edge(0, 1 + i, patterns[p], k + 1)
            for g in mine:
                room = patterns[p] * g.max_repeats
                arcs[p, g.source] = (flow.edge(1 + i, 1 + len(sets) + names.index(g.source), room), room)
        for j, g in enumerate(goals):
            flow.edge(1 + len(sets) + j, end, round(scale * g.share * total))
        sent = flow.push(0, end)
        return sent, {k: room - flow.room[e] for k, (e, room) in arcs.items()}

    low, high = 1.0, 1.0
    while solve(high)[0] < total and high < 1e6:
        high *= 2
    if high == 1.0:
        return solve(1.0)[1]
    if solve(high)[0] < total:  # all sources together cannot reach the total
        return solve(high)[1]
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if solve(mid)[0] < total else (low, mid)
    return solve(high)[1]


def mix(df: DataFrame, item: str, sources: Column, size: str, goals: Sequence[Goal], *, seed: int = 0, bucket_items: int = 100_000, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """(item, source_name, uses, size): which items serve which source, and how often.

    ``sources`` is an ARRAY<STRING> of the sources an item belongs to; null elements do not
    count.  The mixture's size is that of all items with any source, named in the goals or
    not.  Within one source an item is used at most ``max_repeats`` times.  Null sizes count
    as 0; items without a goal's source are not used; an empty table gives an empty result.

    All combinations of sources are routed.  If there are more than ``most_patterns``, those
    that hold least are first merged: their items count for one of their sources, the one
    whose goal is largest for what it has.  No item is lost by it and caps hold as before;
    the routing of those few items is then no longer the cheapest one.
    """
    names = [g.source for g in goals]
    known = F.array_sort(F.array_distinct(F.filter(sources, lambda s: s.isNotNull())))
    rows = df.select(df[item].alias("item"), known.alias("known"), F.coalesce(df[size].cast("bigint"), F.lit(0)).alias("size"))
    rows = rows.where(F.size("known") > 0).withColumn("pattern", F.array_intersect("known", F.lit(names)))
    rows = materialize(rows.select("item", "size", F.array_join("pattern", "\x1f").alias("pattern"), F.xxhash64(F.lit(seed), "item").alias("h")), "mixture")
    rows, found = _routable(rows, names, goals, most_patterns)
    sets = {frozenset(r["pattern"].split("\x1f")): r["size"] for r in found if r["pattern"]}
    flows = route(sets, goals, sum(r["size"] for r in found))

    tape = []
    for p in sets:
        at = 0
        for g in goals:
            if tokens := flows.get((p, g.source), 0):
                tape.append(("\x1f".join(n for n in sorted(p)), g.source, at, at + tokens, sets[p]))
                at += tokens
    pieces = df.sparkSession.createDataFrame(tape, "pattern string, source_name string, a bigint, z bigint, around bigint")

    buckets = max(1, -(-sum(r["n"] for r in found) // bucket_items))
    rows = rows.where("pattern <> ''").withColumn("bucket", F.floor(F.shiftrightunsigned("h", 33) * F.lit(buckets) / F.lit(2.0**31)))
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("inside"))
    ahead = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pattern", "bucket", F.coalesce(F.sum("inside").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "item").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, ["pattern", "bucket"]).withColumn("x", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    turns = lambda end: F.when(end > F.col("x"), F.ceil((end - F.col("x")) / F.col("around"))).otherwise(0)
    return (
        placed.join(F.broadcast(pieces), "pattern")  # at most patterns x goals rows
        .withColumn("uses", (turns(F.col("z")) - turns(F.col("a"))).cast("int"))
        .where("uses > 0")
        .select(F.col("item").alias(item), "source_name", "uses", "size")
    )


def _routable(rows: DataFrame, names: Sequence[str], goals: Sequence[Goal], most: int) -> tuple[DataFrame, list]:
    """The rows with at most ``most`` + len(goals) + 1 patterns, and (pattern, size, n) of each."""
    counted = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    found = counted.orderBy(F.desc("size"), "pattern").limit(most + 1).collect()  # bounded
    if len(found) <= most:
        return rows, found
    largest = F.broadcast(rows.sparkSession.createDataFrame([(r["pattern"],) for r in found[:most]], "pattern string").withColumn("kept", F.lit(True)))
    supply = {r["source"]: r["size"] for r in counted.select(F.explode(F.split("pattern", "\x1f")).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size")).collect()}  # a row per goal
    wanted = sorted(goals, key=lambda g: (-g.share / max(1, supply.get(g.source, 0)), g.source))
    members = F.split("pattern", "\x1f")
    one = F.filter(F.lit([g.source for g in wanted]), lambda x: F.array_contains(members, x))[0]
    merged = F.when(F.col("kept").isNotNull() | (F.col("pattern") == ""), F.col("pattern")).otherwise(one)
    rows = materialize(rows.join(largest, "pattern", "left").withColumn("pattern", merged).drop("kept"), "mixture")
    return rows, rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()


def mixing_faults(mixed: DataFrame, df: DataFrame, item: str, sources: Column, size: str, goals: Sequence[Goal]) -> DataFrame:
    """Per goal: uses above the cap, items that do not belong to the source, and whether the share is short though items were left.

    A share is short if it misses its goal by more than one item's size and some item of the
    source was used less often than it might have been.
    """
    spark = mixed.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(g.source, float(g.share), int(g.max_repeats)) for g in goals], "source_name string, goal_share double, max_repeats int"))
    each = df.select(item, F.coalesce(df[size].cast("bigint"), F.lit(0)).alias("__size"), F.array_distinct(sources).alias("__known"))
    each = each.where(F.size(F.filter("__known", lambda x: x.isNotNull())) > 0)
    total = each.agg(F.coalesce(F.sum("__size"), F.lit(0))).head()[0]
    owned = each.select(item, "__size", F.explode("__known").alias("source_name")).withColumn("owned", F.lit(True))
    both = owned.join(mixed.select(item, "source_name", "uses"), [item, "source_name"], "full").join(wanted, "source_name")
    rows = both.groupBy("source_name", "goal_share").agg(
        F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_repeats"),
        F.count_if(F.col("owned").isNull()).alias("of_others"),
        F.coalesce(F.sum(F.col("uses") * F.col("__size")), F.lit(0)).alias("got"),
        F.count_if((F.coalesce("uses", F.lit(0)) < F.col("max_repeats")) & (F.col("__size") > 0)).alias("left"),
        F.max("__size").alias("largest"),
    )
    short = (F.col("got") + F.col("largest") < F.col("goal_share") * F.lit(total)) & (F.col("left") > 0)
    return wanted.select("source_name").join(rows.withColumn("short", short.cast("bigint")), "source_name", "left").select(
        "source_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("over_repeats", "of_others", "short"))
    )


def share_report(mixed: DataFrame, goals: Sequence[Goal]) -> DataFrame:
    """Per goal: documents, uses and tokens in the mixture, and the share really reached."""
    wanted = mixed.sparkSession.createDataFrame([(g.source, float(g.share), int(g.max_repeats)) for g in goals], "source_name string, goal_share double, max_repeats int")
    got = mixed.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("size")).alias("tokens")
    )
    zero = {"documents": 0, "uses": 0, "most_uses": 0, "tokens": 0}
    rows = wanted.join(got, "source_name", "left").fillna(zero)
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per goal
    return rows.withColumn("share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)))
