import random

import pytest
from pyspark.sql import functions as F

from seqjoin.functions.bases import dinucleotides, hamming, mask, mismatch_budget, reverse_complement, shortened_name, shortened_names, truncated, zero_padded
from seqjoin.functions.sketches import bloom_parameters


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expr(F.col("v"))).collect()]


def test_bases(spark):
    values = ["ATGC", "atgN-", "", None, "AéT", "ACGTX"]
    assert column(spark, values, mask) == ["ATGC", "XXXXX", "", None, "AXT", "ACGTX"]
    assert column(spark, values, lambda c: reverse_complement(mask(c))) == ["GCAT", "XXXXX", "", None, "AXT", "XACGT"]
    assert column(spark, values, lambda c: truncated(c, 2)) == ["AT", "at", "", None, "Aé", "AC"]


def test_dinucleotides_and_hamming_by_brute_force(spark):
    r = random.Random(1)
    texts = ["", "A", "AA", None] + ["".join(r.choice("ATGCN") for _ in range(r.randrange(40))) for _ in range(60)]
    plain = [None if t is None else t.replace("N", "X") for t in texts]
    assert column(spark, texts, dinucleotides) == [None if t is None else len({t[i : i + 2] for i in range(len(t) - 1)}) for t in plain]
    odd = [(None, "A"), ("A", None), ("AB", "A"), ("", ""), ("é", "e"), ("😀A", "😀B")]
    got = spark.createDataFrame(odd, "a string, b string").coalesce(1).select(hamming(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [None, None, None, 0, 1, 1]
    pairs = [(t, "".join(r.choice("ATGCX") if r.random() < 0.2 else c for c in t)) for t in plain if t]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == sum(p != q for p, q in zip(x.a, x.b)) for x in got)


def test_budget_cuts_towards_zero(spark):
    lengths = list(range(1, 301))
    for p in (0.9, 0.96, 1.0, 0.5, 0.7, 0.99):
        assert column(spark, lengths, lambda c, p=p: mismatch_budget(c, p), "int") == [int((1 - p) * float(n)) for n in lengths]
    assert column(spark, [10], lambda c: mismatch_budget(c, 0.9), "int") == [0]


def test_names(spark):
    values = ["x" * 1000, "x" * 1001, "", None]
    assert column(spark, values, shortened_name) == ["x" * 1000, "x" * 995 + "...", "", None]
    assert column(spark, values, shortened_names) == ["x" * 1000, "x" * 996 + "...", "", None]
    assert column(spark, [7, None], zero_padded, "long") == ["00000000007", None]


@pytest.mark.parametrize("n,p", [(100_000_000, 1e-6), (1000, 0.01)])
def test_bloom_parameters(n, p):
    bits, hashes = bloom_parameters(n, p)
    assert (1 - 2.718281828459045 ** (-hashes * n / bits)) ** hashes <= p * 1.05
