"""Filling containers of fixed capacity by minimum bin slack.

Items are spread by hash over shards of a few thousand; in each shard one container after
the other is filled: the largest item left is put in, then a bitset dynamic program over the
lengths still available finds the subset that comes closest to the room left, and those
items are taken out.  Only the last container of a shard stays partly empty, so the loss
falls with the shard's size and the work per shard stays bounded at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fullest(room: int, lengths: Sequence[int], counts: dict[int, int]) -> list[int]:
    """A multiset of the given lengths with the largest sum not above ``room``.

    ``lengths`` in descending order; ``counts`` how often each may be used.  Bit i of the
    bitset says that the sum i can be made; the search ends once ``room`` itself can.
    """
    sums, full, limit = 1, 1 << room, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = (sums | sums << length) & limit
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
            if sums & full:
                break
        if sums & full:
            break
    left, taken = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def pack_items(sizes: Sequence[int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, part, start, size, container) for all items; items above ``capacity`` are split.

    Of a split item every part but the last fills a container of its own.  Items of size 0
    go into the first container.
    """
    stacks: dict[int, list[tuple[int, int, int]]] = {}
    container = 0
    for item, size in enumerate(sizes):
        part = start = 0
        while size - start > capacity:
            yield item, part, start, capacity, container
            container, part, start = container + 1, part + 1, start + capacity
        if size - start or not size:
            stacks.setdefault(size - start, []).append((item, part, start))
    empty = stacks.pop(0, [])
    first = container
    lengths = sorted(stacks, reverse=True)
    counts = {x: len(stacks[x]) for x in lengths}

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            lengths.remove(length)
        return stacks[length].pop()

    while lengths:
        largest = lengths[0]
        chosen = [(largest, take(largest))]
        for length in fullest(capacity - largest, lengths, counts):
            chosen.append((length, take(length)))
        for length, (item, part, start) in chosen:
            yield item, part, start, length, container
        container += 1
    for item, part, start in empty:
        yield item, part, start, 0, first


def pack(df: DataFrame, item: str, size: str, capacities: Sequence[tuple[str, int]], *, shard_items: int = 8192) -> DataFrame:
    """(pack_kind, container, item, part_no, part_start, part_size): every item of every kind of container.

    ``capacities`` are (kind, capacity) pairs, each a task of its own.  An item is split only
    if it alone exceeds the capacity.  ``container`` is unique within its kind.  Null sizes
    count as 0, and items of size 0 are assigned like others; equal items are packed singly;
    an empty table gives an empty result.
    """
    item_type = df.schema[item].dataType.simpleString()
    rows = df.select(df[item].alias("item"), F.coalesce(df[size].cast("bigint"), F.lit(0)).alias("size"))
    shards = max(1, -(-rows.count() // shard_items))
    kinds = F.array(*(F.struct(F.lit(k).alias("pack_kind"), F.lit(int(c)).cast("bigint").alias("capacity")) for k, c in capacities))

    def fill(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        shard, kind, capacity = key
        got = got.sort_values(["item", "size"], kind="stable")
        items = got["item"].to_numpy()
        packed = list(pack_items(got["size"].tolist(), int(capacity)))
        out = pd.DataFrame(packed, columns=["at", "part_no", "part_start", "part_size", "container"])
        out["container"] += int(shard) << 32
        out["item"] = items[out["at"].to_numpy()]
        out["pack_kind"] = kind
        return out[["pack_kind", "container", "item", "part_no", "part_start", "part_size"]]

    return (
        rows.withColumn("shard", F.pmod(F.xxhash64("item", "size"), F.lit(shards)))
        .select("item", "size", "shard", F.inline(kinds))
        .groupBy("shard", "pack_kind", "capacity")
        .applyInPandas(fill, f"pack_kind string, container bigint, item {item_type}, part_no int, part_start bigint, part_size bigint")
        .withColumnRenamed("item", item)
    )


def fill_report(packed: DataFrame, capacities: Sequence[tuple[str, int]]) -> DataFrame:
    """Per kind: containers used, tokens in them, the share of room filled, and the least number of containers possible."""
    rows = packed.groupBy("pack_kind").agg(F.countDistinct("container").alias("containers"), F.sum("part_size").alias("tokens"))
    capacity = F.element_at(F.create_map(*(F.lit(x) for k, c in capacities for x in (k, int(c)))), F.col("pack_kind"))
    return rows.select(
        "pack_kind", capacity.cast("bigint").alias("capacity"), "containers", "tokens",
        F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("filled"),
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
    )


def packing_faults(packed: DataFrame, sized: DataFrame, item: str, size: str, capacities: Sequence[tuple[str, int]]) -> DataFrame:
    """Per kind: items, and how many containers or items break a rule.

    ``over_capacity``: containers that hold more than their capacity.  ``wrong_size``: items
    whose parts do not add up to their size, or that are missing.  ``split_needlessly``: items
    in several parts though they fit into a container.  ``not_joined``: parts that do not
    begin where the one before ends.
    """
    kinds = sized.sparkSession.createDataFrame([(k, int(c)) for k, c in capacities], "pack_kind string, capacity bigint")
    over = packed.groupBy("pack_kind", "container").agg(F.sum("part_size").alias("held")).join(F.broadcast(kinds), "pack_kind").where("held > capacity")
    over = over.groupBy("pack_kind").agg(F.count(F.lit(1)).alias("over_capacity"))
    before = F.coalesce(F.lag(F.col("part_start") + F.col("part_size")).over(Window.partitionBy("pack_kind", item).orderBy("part_no")), F.lit(0))
    parts = packed.withColumn("gap", (F.col("part_start") != before).cast("int"))
    got = parts.groupBy("pack_kind", item).agg(F.sum("part_size").alias("got"), F.count(F.lit(1)).alias("parts"), F.sum("gap").alias("gaps"))
    wanted = sized.select(item, F.coalesce(F.col(size), F.lit(0)).alias("wanted"), F.inline(F.array(*(F.struct(F.lit(k).alias("pack_kind"), F.lit(int(c)).alias("capacity")) for k, c in capacities))))
    each = wanted.join(got, ["pack_kind", item], "full")
    items = each.groupBy("pack_kind").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(~F.col("wanted").eqNullSafe(F.col("got"))).alias("wrong_size"),
        F.count_if((F.col("parts") > 1) & (F.col("wanted") <= F.col("capacity"))).alias("split_needlessly"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("not_joined"),
    )
    return items.join(over, "pack_kind", "left").fillna(0).select("pack_kind", "n_items", "over_capacity", "wrong_size", "split_needlessly", "not_joined")
