import random

import pytest

from seqjoin.llm.topn import score_thresholds, top_n_per_group

SCHEMA = "seq string, nmiss int, target string, row_no long, __g string, rank int, s int"


def rows_of(seed, n=4000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = r.choice(["HOT", "HOT", None, "", *"ABCDEFGH", f"g{r.randrange(500)}", "L" * 600])
        score = r.choice([None, *range(-3, 12)]) if g != "E" else 4
        out.append((g, score, r.choice(["t1", "t2", None, "Ä"]), i, "x", 9, 1))
    return out


def brute(rows, n):
    groups = {}
    for row in rows:
        if row[0] is not None and row[1] is not None:
            groups.setdefault(row[0], []).append(row)
    key = lambda x: (x[1], x[2] is not None, (x[2] or "").encode(), x[3])
    return sorted((x[3], i + 1) for g in groups.values() for i, x in enumerate(sorted(g, key=key)[:n]))


@pytest.mark.parametrize("n,options", [(3, {}), (1, {"min_rows": 2}), (40, {"min_rows": 41}), (3, {"min_rows": 4, "most_groups": 2}), (3, {"min_rows": 10**6}), (10_000, {})])
def test_against_sorting_every_group(spark, n, options):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = top_n_per_group(df, "seq", "nmiss", ["target", "row_no"], n, **options)
    assert set(got.columns) == set(df.columns)
    assert sorted((r.row_no, r.rank) for r in got.collect()) == brute(rows, n)


@pytest.mark.parametrize("scale,shift", [(1e-9, 0.0), (1.0, 0.0), (1e6, 1e12), (-1.0, 0.0)])
def test_a_hot_group_of_any_scores_is_filtered(spark, scale, shift):
    """Edges come from the scores themselves: a far outlier or a narrow range changes nothing."""
    r = random.Random(7)
    rows = [("HOT", shift + scale * r.random(), i) for i in range(20_000)] + [("HOT", -1e300, 20_000)] + [(f"g{i}", 0.5, 30_000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, score double, no long")
    limits = {x.g: x.top for x in score_thresholds(df, "g", "score", ["no"], 3, min_rows=48).collect()}
    assert set(limits) == {"HOT"}
    kept = sum(s <= limits["HOT"] for g, s, _ in rows if g == "HOT")
    assert 3 <= kept <= 2000
    got = {x.no for x in top_n_per_group(df, "g", "score", ["no"], 3).collect()}
    assert got == {no for _, _, no in sorted(rows[:20_001], key=lambda x: (x[1], x[2]))[:3]} | {no for *_, no in rows[20_001:]}


def test_thresholds_are_bounded_and_safe(spark):
    df = spark.createDataFrame([(f"g{i % 50}", (i * 7919) % 1000, i) for i in range(10_000)], "g string, score int, no long")
    limits = score_thresholds(df, "g", "score", ["no"], 5, min_rows=10, most_groups=7).collect()
    assert len(limits) <= 7
    for x in limits:
        assert df.where((df.g == x.g) & (df.score <= x.top)).count() >= 5
    assert score_thresholds(df, "g", "score", ["no"], 5, min_rows=10, key_bytes=1) is None


def test_empty_and_small(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_n_per_group(none, "seq", "nmiss", ["row_no"]).count() == 0
    one = spark.createDataFrame([("A", 1, None, 1, None, None, None)], SCHEMA)
    assert top_n_per_group(one, "seq", "nmiss", ["row_no"]).head()["rank"] == 1


def test_threshold_drops_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([("hot", i % 50, i) for i in range(1000)], "g string, s int, n long")
    got = top_n_per_group(df, "g", "s", ["n"], 3)
    assert sorted(r["n"] for r in got.collect()) == [0, 50, 100]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan
    long = spark.createDataFrame([("x" * 200_000, i, i) for i in range(60)], "g string, s int, n long")
    assert top_n_per_group(long, "g", "s", ["n"], 3).count() == 3
