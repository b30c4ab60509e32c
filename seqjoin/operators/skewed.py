"""Per-key results over tables in which a few keys hold most rows.

No step groups raw rows on a hot key alone.  Rows are first combined on the map side into
states of (key, other) pairs, which hash evenly however hot either of the two is; the pair
states are combined once more on the map side per key, so that of a hot key at most one
state per task and key travels.  All states are algebraic SQL aggregates: Spark's hash
aggregation keeps them in bounded memory and spills them sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile_keys(df: DataFrame, fields: dict[str, Column], least: dict[str, Column] | None = None) -> DataFrame:
    """Rows, distinct partners and minima for every value of each of two key fields.

    ``fields`` maps two field names to key columns; each is the other's partner.  ``least``
    maps result names to columns whose smallest value per key is wanted.  The result is
    (key_field, key_value STRING, n_rows, n_partners, *least).

    Null keys form a key of their own (key_value null); empty keys are ordinary keys.  Null
    partners are not counted as partners.  Minima ignore nulls and are null where all are.
    An empty table gives an empty result; other columns, also of clashing names, are not read.
    """
    (name_a, key_a), (name_b, key_b) = fields.items()
    least = least or {}
    kept = df.select(key_a.cast("string").alias("__a"), key_b.cast("string").alias("__b"), *(c.alias(f"__m{i}") for i, c in enumerate(least.values())))
    minima = [F.min(f"__m{i}").alias(f"__m{i}") for i in range(len(least))]
    pairs = kept.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n"), *minima)
    sides = F.array(
        F.struct(F.lit(name_a).alias("key_field"), F.col("__a").alias("key_value"), F.col("__b").isNotNull().alias("__has")),
        F.struct(F.lit(name_b).alias("key_field"), F.col("__b").alias("key_value"), F.col("__a").isNotNull().alias("__has")),
    )
    return (
        pairs.select(F.inline(sides), "__n", *(f"__m{i}" for i in range(len(least))))
        .groupBy("key_field", "key_value")
        .agg(
            F.sum("__n").alias("n_rows"),
            F.count_if("__has").alias("n_partners"),
            *(F.min(f"__m{i}").alias(name) for i, name in enumerate(least)),
        )
    )


def count_keys(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(key_field, key_value STRING, n_rows) for every value of each key field; null keys form a key of their own.

    Only map-side counts travel: of a hot key one number per task.
    """
    sides = F.array(*(F.struct(F.lit(name).alias("key_field"), key.cast("string").alias("key_value")) for name, key in fields.items()))
    return df.select(F.inline(sides)).groupBy("key_field", "key_value").agg(F.count(F.lit(1)).alias("n_rows"))


def hot_keys(df: DataFrame, fields: dict[str, Column], share: float) -> DataFrame:
    """(key_field, key_value, n_rows) of keys that hold at least ``share`` of all rows of ``df``.

    Null and empty keys count towards the total but are never reported.
    """
    total = df.count()
    return count_keys(df, fields).where(
        F.col("key_value").isNotNull() & (F.col("key_value") != "") & (F.col("n_rows") >= F.lit(float(share)) * F.lit(total))
    )
