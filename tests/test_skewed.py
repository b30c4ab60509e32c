import random
from collections import defaultdict

from pyspark.sql import functions as F

from seqjoin.operators.skewed import hot_keys, profile_keys

SCHEMA = "k string, t long, pos int, __n int, n_rows string"


def rows(seed, n):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 20 + ["a", "", None, "x" * 5000]), r.choice([1] * 10 + [2, None, 3]), r.choice([5, 9, None]), 1, "z") for _ in range(n)]


def brute(data, key, partner):
    groups = defaultdict(list)
    for r in data:
        groups[None if r[key] is None else str(r[key])].append(r)
    least = lambda g: min((r[2] for r in g if r[2] is not None), default=None)
    return {k: (len(g), len({r[partner] for r in g} - {None}), least(g)) for k, g in groups.items()}


def test_profile_against_brute_force(spark):
    data = rows(1, 900)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = profile_keys(df, {"k": F.col("k"), "t": F.col("t")}, {"least_pos": F.col("pos")}).collect()
    for name, a, b in (("k", 0, 1), ("t", 1, 0)):
        assert {r.key_value: (r.n_rows, r.n_partners, r.least_pos) for r in got if r.key_field == name} == brute(data, a, b)


def test_hot_keys_and_empty(spark):
    data = rows(2, 400)
    df = spark.createDataFrame(data, SCHEMA)
    fields = {"k": F.col("k"), "t": F.col("t")}
    got = {(r.key_field, r.key_value) for r in hot_keys(df, fields, 0.5).collect()}
    assert got == {("k", "hot"), ("t", "1")}
    assert profile_keys(df.limit(0), fields).count() == hot_keys(df.limit(0), fields, 0.1).count() == 0


def test_raw_rows_never_shuffle_by_a_hot_key(spark):
    df = spark.range(20_000).selectExpr("'hot' AS k", "id % 50 AS t", "1 AS pos")
    got = profile_keys(df, {"k": F.col("k"), "t": F.col("t")})
    assert {(r.key_value, r.n_rows) for r in got.collect() if r.key_field == "k"} == {("hot", 20_000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 4
