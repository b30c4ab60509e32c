"""Bloom filters: their sizes, and as column expressions that stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark builds no filter of more bits by default.
MOST_BITS = 1 << 26


def bloom_parameters(items: int, false_positives: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for so many items at such a rate."""
    bits = math.ceil(-items * math.log(false_positives) / math.log(2) ** 2)
    return bits, math.ceil(math.log(2) * bits / items)


def _of_expression(jvm, expression) -> Column:
    from pyspark.sql.classic.column import Column as ClassicColumn

    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _expression(jvm, column: Column):
    return jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)


def _filter_of(hashes: DataFrame, items: int, bits: int) -> Column:
    """A Bloom filter of the BIGINT column ``h`` as a scalar subquery, built by partial aggregation when the query runs."""
    jvm = hashes.sparkSession._jvm
    number = lambda n: _expression(jvm, F.lit(n).cast("bigint"))
    made = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(_expression(jvm, F.col("h")), number(items), number(bits))
    return hashes.agg(_of_expression(jvm, made.toAggregateExpression()).alias("b")).scalar()


def may_be_among(value: Column, values: DataFrame, column: str, items: int, *, false_positives: float = 0.01, most_filters: int = 8, builders: int = 64) -> Column:
    """Whether a value may be in ``column`` of ``values``, some ``items`` rows: never wrong if it is, seldom if it is not.

    Values are told apart by 64-bit hashes, dealt out to as many filters of at most MOST_BITS
    bits as the rate asks for.  With more items than ``most_filters`` filters are made for
    (some 56 million at one in a hundred) more wrong values pass.  A task carries all filters,
    at most 8 MB each.  ``builders`` bounds the partial filters that are merged into one.
    """
    jvm = values.sparkSession._jvm
    bits, _ = bloom_parameters(max(1, items), false_positives)
    n = min(most_filters, -(-bits // MOST_BITS))
    each, items_each = max(64, min(MOST_BITS, -(-bits // n))), max(1, -(-items // n))
    hashes = values.select(F.xxhash64(column).alias("h")).coalesce(builders)
    h = F.xxhash64(value)
    part = lambda x: F.pmod(F.shiftright(x, 32), F.lit(n))
    contains = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    tests = [
        _of_expression(jvm, contains(_expression(jvm, _filter_of(hashes.where(part(F.col("h")) == i) if n > 1 else hashes, items_each, each)), _expression(jvm, h)))
        for i in range(n)
    ]
    held = tests[0] if n == 1 else reduce(lambda found, i: found.when(part(h) == i, tests[i]), range(1, n), F.when(part(h) == 0, tests[0]))
    return F.coalesce(held, F.lit(False))  # a filter of no rows is null
