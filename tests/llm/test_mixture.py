import random

from pyspark.sql import functions as F

from seqjoin.llm.mixture import Flow, Goal, mix, mixing_faults, route, share_report

GOALS = [Goal("a", 0.5, 1), Goal("b", 0.3, 4), Goal("c", 0.15, 2), Goal("none", 0.05, 4)]


def test_flow_is_cheapest():
    f = Flow(4)
    cheap, dear = f.edge(0, 1, 5, 1), f.edge(0, 2, 5, 3)
    f.edge(1, 3, 4), f.edge(2, 3, 9)
    assert f.push(0, 3) == 9 and (f.room[cheap], f.room[dear]) == (1, 0)


def test_route_meets_goals_and_raises_the_others():
    p = lambda *x: frozenset(x)
    got = route({p("a"): 900, p("b"): 60, p("c"): 40}, GOALS, 1000)
    by = {s: sum(v for (_, t), v in got.items() if t == s) for s in "abc"}
    assert by["b"] == 240 and by["c"] == 80 and abs(sum(by.values()) - 1000) <= 2
    both = route({p("a", "b"): 500, p("a"): 500}, [Goal("a", 0.5, 1), Goal("b", 0.5, 1)], 1000)
    assert both == {(p("a", "b"), "a"): 0, (p("a", "b"), "b"): 500, (p("a"), "a"): 500}
    assert route({}, GOALS, 0) == {}


def test_mix_holds_caps_and_shares(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 12 + ["b", "c", "other", None]), r.choice([None, 0, 1, 50, 200]), 1, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, source string, size int, pattern int, h int")
    got = mix(df, "id", F.array("source"), "size", GOALS, bucket_items=200)
    used = got.collect()
    assert len({(r.id, r.source_name) for r in used}) == len(used)
    source = {i: s for i, s, *_ in rows}
    most = {g.source: g.max_repeats for g in GOALS}
    assert all(source[x.id] == x.source_name and 1 <= x.uses <= most[x.source_name] for x in used)
    total = sum(z or 0 for _, s, z, *_ in rows if s)
    assert abs(sum(x.uses * x["size"] for x in used) - total) <= 3 * 200
    report = {x.source_name: x for x in share_report(got, GOALS).collect()}
    assert report["none"].tokens == 0 and report["b"].most_uses == 4
    assert sorted(map(tuple, used)) == sorted(map(tuple, mix(df.repartition(7), "id", F.array("source"), "size", GOALS, bucket_items=200).collect()))
    other = mix(df, "id", F.array("source"), "size", [Goal("a", 0.2, 1), Goal("b", 0.8, 1)], seed=1)
    assert max(x.uses for x in other.collect()) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "id long, source string, size int")
    got = mix(df, "id", F.array("source"), "size", GOALS)
    assert got.count() == 0 and all(x.share == 0 for x in share_report(got, GOALS).collect())


def test_overlapping_sources_beyond_the_patterns_routed(spark):
    """Fourteen sources that overlap freely: more combinations than are routed as they are, yet nothing is lost and caps hold."""
    r = random.Random(9)
    names = [f"s{i:02d}" for i in range(14)]
    goals = [Goal(n, 1 / 14, 3) for n in names]
    rows = [(i, r.sample(names, r.randrange(1, 8)) + [None] * (i % 2), r.randrange(1, 50)) for i in range(1500)] + [(9999, ["other"], 7), (9998, [], 5), (9997, None, 5)]
    df = spark.createDataFrame(rows, "id long, known array<string>, size int")
    for most in (4096, 40):
        mixed = mix(df, "id", F.col("known"), "size", goals, most_patterns=most)
        faults = mixing_faults(mixed, df, "id", F.col("known"), "size", goals).collect()
        assert [(x.over_repeats, x.of_others) for x in faults] == [(0, 0)] * 14
        shares = [x.share for x in share_report(mixed, goals).collect()]
        assert abs(sum(x.uses * x["size"] for x in mixed.collect()) - sum(x[2] for x in rows[:1501])) <= 14 * 50
        assert max(abs(x - 1 / 14) for x in shares) < 0.01


def test_faults_are_seen(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "b", 10)], "id long, source string, size int")
    mixed = spark.createDataFrame([(1, "a", 3, 10), (3, "a", 1, 10), (3, "b", 1, 10)], "id long, source_name string, uses int, size int")
    goals = [Goal("a", 0.1, 2), Goal("b", 0.9, 4), Goal("none", 0.1, 1)]
    got = {x.source_name: (x.over_repeats, x.of_others, x.short) for x in mixing_faults(mixed, df, "id", F.array("source"), "size", goals).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 1), "none": (0, 0, 0)}
