"""Expressions on base sequences and read names."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def mask(seq: Column) -> Column:
    """Everything but upper-case A, T, G, C becomes X."""
    return F.regexp_replace(seq, "[^ATGC]", "X")


def reverse_complement(seq: Column) -> Column:
    """The masked sequence of the other strand; X stays X."""
    return F.translate(F.reverse(seq), "ATGC", "TACG")


def truncated(seq: Column, most: int) -> Column:
    return F.substring(seq, 1, most)


def shortened_name(name: Column) -> Column:
    """Names above 1000 characters keep their first 995."""
    return F.when(F.length(name) > 1000, F.concat(F.substring(name, 1, 995), F.lit("..."))).otherwise(name)


def shortened_names(names: Column) -> Column:
    """Lists of names above 1000 characters keep their first 996."""
    return F.when(F.length(names) > 1000, F.concat(F.substring(names, 1, 996), F.lit("..."))).otherwise(names)


_PAIRS = [a + b for a in "ATGCX" for b in "ATGCX"]


def dinucleotides(seq: Column, masked: bool = False) -> Column:
    """How many different pairs of neighbours occur (INT); characters outside ATGC count as one."""
    plain = seq if masked else mask(seq)
    return reduce(add, (F.when(F.contains(plain, F.lit(p)), 1).otherwise(0) for p in _PAIRS)) + F.when(seq.isNull(), None).otherwise(0)


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One number per character of all texts, and where each text begins and ends."""
    whole = pc.fill_null(texts, "")
    lengths = pc.utf8_length(whole).to_numpy(zero_copy_only=False)
    wide = "".join(whole.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(wide, np.uint32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


@F.arrow_udf(IntegerType())
def hamming(a: pa.Array, b: pa.Array) -> pa.Array:
    """Positions at which two texts of equal length differ (INT); null for null or unequal lengths.

    Whole Arrow batches are compared at once, some hundred times as fast as an array
    function over the characters of each pair.
    """
    (left, at), (right, other) = _plain(a), _plain(b)
    valid = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    if not np.array_equal(at, other):
        valid = valid & (np.diff(at) == np.diff(other))
        pairs = zip(np.where(valid, a.to_pylist(), ""), np.where(valid, b.to_pylist(), ""))
        kept = [(x, y) for x, y in pairs]
        (left, at), (right, _) = (_plain(pa.array([p[i] for p in kept], pa.string())) for i in (0, 1))
    sums = np.concatenate([[0], np.cumsum(left != right)])
    return pa.array((sums[at[1:]] - sums[at[:-1]]).astype(np.int32), pa.int32(), mask=~valid)


def mismatch_budget(length: Column, p_match: float) -> Column:
    """The most mismatches allowed in a read of this length; doubles, cut off towards zero."""
    return (F.lit(1.0 - float(p_match)) * length).cast("int")


def first_word(text: Column) -> Column:
    """What comes before the first blank, leading blanks aside."""
    return F.regexp_extract(text, r"^\s*(\S*)", 1)


def zero_padded(number: Column) -> Column:
    """Eleven digits."""
    return F.lpad(number.cast("string"), 11, "0")
