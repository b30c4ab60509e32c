import random
from collections import Counter

import numpy as np

from seqjoin.llm.heavy import PrefixSketch, frequent_values


def test_sketch_adds_up_and_descends():
    r = np.random.default_rng(3)
    heavy = r.integers(0, 2**64, 5, np.uint64)
    rows = np.concatenate([np.repeat(heavy, 1000), r.integers(0, 2**64, 50_000, np.uint64)])
    r.shuffle(rows)
    whole, left, right = PrefixSketch(), PrefixSketch(), PrefixSketch()
    whole.add(rows), left.add(rows[:20_000]), right.add(rows[20_000:])
    for (p, a), (_, b), (_, c) in zip(left.parts(), right.parts(), whole.parts()):
        assert (a + b == c).all(), p
    found, estimates = whole.heavy(500)
    assert {int(x) >> 20 for x in heavy} == set(map(int, found))
    assert (abs(estimates - 1000) < 250).all()


def test_against_exact_counts(spark):
    r = random.Random(5)
    values = ["hot"] * 3000 + ["warm"] * 300 + [None] * 50 + [""] * 900 + [f"v{r.randrange(10**6)}" for _ in range(5000)] + ["x" * 100_000] * 200
    r.shuffle(values)
    df = spark.createDataFrame([(v, 1, 2) for v in values], "value string, estimate int, prefix int").repartition(6)
    got = {x["value"]: x["n_rows"] for x in frequent_values(df, "value", 0.02).collect()}
    assert got == {v: n for v, n in Counter(values).items() if v and n >= 0.02 * len(values)}


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(x,) for x in "ab" * 50], "value string")
    assert sorted((x["value"], x["n_rows"]) for x in frequent_values(df, "value", 0.5).collect()) == [("a", 50), ("b", 50)]
    for rows in ([], [(None,)] * 3, [("",)] * 3):
        assert frequent_values(spark.createDataFrame(rows, "value string"), "value", 0.1).count() == 0


def test_sketches_of_many_tasks_are_added_in_groups(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS v").repartition(300)
    assert [(r.v, r.n_rows) for r in frequent_values(df, "v", 0.1).collect()] == [("hot", 1000)]


def test_a_sketch_too_narrow_is_made_again(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS v")
    assert [(r.v, r.n_rows) for r in frequent_values(df, "v", 0.1, depth=1, width_bits=1).collect()] == [("hot", 1000)]
