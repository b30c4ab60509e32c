import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqjoin.config import Config
from seqjoin.operators import match as m
from seqjoin.operators.reads import prepare_reads, read_windows, seq_info, unique_reads, window_counts
from seqjoin.operators.targets import prepare_targets, stretches, target_windows
from seqjoin.plans import synthetic
from seqjoin.plans.pipeline import match

CFG = Config(Windows=(0, 5), WindowWidth=6, PMatch=0.8, MinDinuc=2, MinReadLength=8, MaxReadLength=20, MMTol=1)


def data(seed):
    r = random.Random(seed)
    base = lambda n, s="ATGC": "".join(r.choice(s) for _ in range(n))
    targets = [(f"t{i}", base(r.randrange(60), "ATGCN")) for i in range(25)] + [("AA", "A" * 30)]
    reads = []
    for i in range(120):
        t = r.choice(targets)[1] or "ATGC"
        at = r.randrange(len(t))
        s = "".join(r.choice("ATGCa") if r.random() < 0.06 else c for c in t[at : at + r.choice([3, 9, 15, 25])])
        reads.append((f"@r{i % 100}", s))
    return reads + [("@dup", reads[0][1])] * 3 + [(None, reads[1][1]), ("@none", None), ("", reads[2][1])], targets


def clean(s):
    return "".join(c if c in "ATGC" else "X" for c in s)


def brute(reads, targets, cfg):
    """Results by nested loops over all windows, reads and targets."""
    names = defaultdict(list)
    for name, s in reads:
        if s is not None and len(s) >= cfg.MinReadLength:
            names[clean(s)[: cfg.MaxReadLength]].append(name)
    groups = defaultdict(list)
    for s in names:
        for w, q in enumerate(cfg.Windows):
            key = s[q : q + cfg.WindowWidth]
            if len(key) < cfg.WindowWidth or len({key[i : i + 2] for i in range(len(key) - 1)}) < cfg.MinDinuc:
                continue
            for num, (_, t) in enumerate(targets):
                t = clean(t)
                for p in range(q, len(t) - cfg.WindowWidth + 1):
                    pos = p - q
                    sub = t[pos : pos + len(s)]
                    miss = sum(a != b for a, b in zip(s, sub))
                    if t[p : p + cfg.WindowWidth] == key and len(sub) == len(s) and miss <= int((1 - cfg.PMatch) * float(len(s))):
                        tail = t[pos : pos + cfg.MaxReadLength]
                        first = (tail[:q], tail[q + cfg.WindowWidth :], num, str(pos + q), s[:q], s[q + cfg.WindowWidth :])
                        groups[w, key].append((s, sub, pos, miss, num, first))
    hits = set()
    for found in groups.values():
        found.sort(key=(lambda h: h[5]) if cfg.MatchMode == "first" else (lambda h: (h[3], h[4], h[2], h[0])))
        hits.update(h[:5] for h in found[: cfg.MaxMatches + (cfg.MatchMode == "first")])
    least = {}
    for h in hits:
        least[h[0]] = min(h[3], least.get(h[0], 99))
    out = []
    for s, sub, pos, miss, num in hits:
        if miss <= least[s] + cfg.MMTol:
            listed = ";".join(sorted(n for n in names[s] if n is not None))
            out.append((s, sub, pos, miss, targets[num][0], len(targets[num][1]), len(names[s]), listed))
    return sorted(out), {s for s in names} - {h[0] for h in out}


@pytest.mark.parametrize(
    "changes",
    [{}, {"PMatch": 1.0, "MMTol": 0}, {"MMTol": 2, "MinDinuc": 0}, {"MaxMatches": 1}, {"MaxMatches": 2, "MatchMode": "first"}, {"MaxReadLength": 9}, {"MinReadLength": 0}, {"Windows": (5, 5, 0)}],
)
def test_pipeline_against_nested_loops(spark, changes):
    cfg = replace(CFG, **changes)
    reads, targets = data(3)
    found = match(
        spark.createDataFrame(reads, "name string, seq string").repartition(3),
        prepare_targets(spark.createDataFrame([(i, *t) for i, t in enumerate(targets)], "num long, name string, seq string")),
        cfg,
    )
    want, missing = brute(reads, targets, cfg)
    assert len(want) > 5
    assert sorted(map(tuple, found.results.collect())) == want
    assert {r.seq for r in found.non_matches.collect()} == missing
    per_target = defaultdict(int)
    for w in want:
        per_target[w[4]] += 1
    assert {r.target: r.n for r in found.target_stats.collect()} == per_target
    assert {r.seq: r.targets for r in found.read_stats.collect()} == {s: ";".join(sorted({w[4] for w in want if w[0] == s})) for s in {w[0] for w in want}}


def test_large_caps_rank_only_large_groups(spark, monkeypatch):
    monkeypatch.setattr(m, "_GROUP_LIMIT", 0)
    test_pipeline_against_nested_loops(spark, {"MaxMatches": 2})


def test_pipeline_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    test_pipeline_against_nested_loops(spark, {})


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "name string, seq string")
    targets = prepare_targets(spark.createDataFrame([(0, "t", "ATGCATGCATGC")], "num long, name string, seq string"))
    found = match(none, targets, CFG)
    assert found.results.count() == found.non_matches.count() == found.read_stats.count() == found.target_stats.count() == 0
    assert seq_info(found.reads).head().asDict() == {"NumUnique": 0, "NumTotal": 0}
    reads = spark.createDataFrame([("r", "ATGCATGCATGC")], "name string, seq string")
    assert match(reads, targets.limit(0), CFG).non_matches.count() == 1


def test_read_ends_at_target_end_and_x_matches_x(spark):
    targets = prepare_targets(spark.createDataFrame([(0, "t", "GGATGCATNCAT")], "num long, name string, seq string"))
    reads = spark.createDataFrame([("end", "ATGCATnCAT"), ("over", "ATGCATNCATG")], "name string, seq string")
    got = match(reads, targets, CFG).results.collect()
    assert [(r.names, r.pos, r.nmiss, r["sub"]) for r in got] == [("end", 2, 0, "ATGCATXCAT")]


def test_reads_and_windows(spark):
    reads = spark.createDataFrame([("b", "ATGCATGC"), ("a", "ATGCATGC"), (None, "ATGCATGC"), ("c", "ATG"), ("n" * 1200, "GGGGGGGG")], "name string, seq string")
    unique = unique_reads(prepare_reads(reads, CFG))
    assert {(r.seq, r["count"], r.names) for r in unique.collect()} == {("ATGCATGC", 3, "a;b"), ("GGGGGGGG", 1, "n" * 995 + "...")}
    windows = read_windows(unique, CFG)
    assert [(r.win, r.q1, r.key) for r in windows.collect()] == [(0, 0, "ATGCAT")]
    assert [tuple(r) for r in window_counts(windows).collect()] == [(0, 1)]


def test_hot_read_lists_as_many_names_as_fit(spark):
    rows = spark.range(3000).selectExpr("concat('name', lpad(id, 6, '0')) AS name", "'ATGCATGCAA' AS seq")
    got = unique_reads(prepare_reads(rows, CFG)).head()
    assert got["count"] == 3000 and got.names == ";".join(f"name{i:06d}" for i in range(3000))[:996] + "..."


def test_target_windows_of_long_targets(spark):
    r = random.Random(5)
    texts = {0: "".join(r.choice("ATGC") for _ in range(10_000)), 1: "ATGCAT", 2: "ATG", 3: ""}
    targets = prepare_targets(spark.createDataFrame([(i, "t", t) for i, t in texts.items()], "num long, name string, seq string"))
    got = {(x.num, x.p, x.key) for x in target_windows(targets, 6).collect()}
    assert got == {(i, p, t[p : p + 6]) for i, t in texts.items() for p in range(len(t) - 5)}
    assert stretches(targets, 5, 6).count() == 4 and stretches(targets, 100).where("num = 3").count() == 0


def test_reverse_complements_and_numbers(spark):
    rows = spark.createDataFrame([("a", "AATGN"), ("b", "CC"), ("c", None)], "name string, seq string").coalesce(1)
    got = [tuple(r) for r in prepare_targets(rows, rev=True).orderBy("num").collect()]
    assert got == [(0, "a", "AATGX", 5), (1, "a_r", "XCATT", 5), (2, "b", "CC", 2), (3, "b_r", "GG", 2)]


def test_screen_loses_no_window(spark):
    reads, targets = data(4)
    windows = read_windows(unique_reads(prepare_reads(spark.createDataFrame(reads, "name string, seq string"), CFG)), CFG)
    kmers = target_windows(prepare_targets(spark.createDataFrame([(i, *t) for i, t in enumerate(targets)], "num long, name string, seq string")), 6)
    exact = {tuple(r) for r in kmers.join(windows.select("key").distinct(), "key", "left_semi").select("num", "p", "key").collect()}
    passed = {tuple(r) for r in m.screen(kmers, windows).collect()}
    assert exact <= passed and len(passed - exact) <= 0.05 * kmers.count()
    assert m.screen(kmers, windows.limit(0)).count() == 0


def test_filters_are_shared_out_over_many_keys(spark):
    from seqjoin.functions import sketches

    values = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("key"))
    passed = spark.range(4000).where(sketches.may_be_among(F.col("id").cast("string"), values, "key", 200_000_000, most_filters=3)).count()
    assert 2000 <= passed <= 2050


@pytest.mark.parametrize("share", [1 / 1024, 0.01])
def test_large_seed_search_shuffles_screened_windows_once(spark, share, monkeypatch):
    """Beyond the broadcast bound target windows are screened where they are made and shuffled once; hot keys are spread."""
    monkeypatch.setattr(m, "HOT_SHARE", share)
    reads, targets = data(6)
    reads = spark.createDataFrame(reads + [(f"@h{i}", "ATGCATGC" + "ACGT"[i % 4] * 2 + "ATGC"[i // 4 % 4] * 2) for i in range(16)], "name string, seq string")
    targets = prepare_targets(spark.createDataFrame([(i, *t) for i, t in enumerate(targets + [("h", "ATGCATGCATGCATGC")] * 3)], "num long, name string, seq string"))
    windows = read_windows(unique_reads(prepare_reads(reads, CFG)), CFG)
    want = {tuple(r) for r in m.seed_join(windows, target_windows(targets, 6)).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = m.candidates(windows, target_windows(targets, 6), broadcast_bytes=0)
        assert {tuple(r) for r in found.collect()} == want and len(want) > 100
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "might_contain" in plan
        assert plan.count("Exchange hashpartitioning(key#") == 2  # one a side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fitting_over_stretches_of_long_targets(spark):
    r = random.Random(8)
    text = "".join(r.choice("ATGC") for _ in range(3 * m.STRETCH + 10))
    targets = prepare_targets(spark.createDataFrame([(0, "t", text), (1, "u", text[:5])], "num long, name string, seq string"))
    at = [0, m.STRETCH - 1, m.STRETCH, 2 * m.STRETCH - 7, len(text) - 10, len(text) - 9, len(text) - 1]
    pairs = spark.createDataFrame([("A" * 10, 0, p) for p in at] + [("A" * 5, 1, 0), ("A" * 5, 1, 1)], "seq string, num long, pos int")
    got = {(x.num, x.pos): (x["sub"], x["tail"]) for x in m.fitting(pairs, targets, 20, tail=True).collect()}
    assert got == {(0, p): (text[p : p + 10], text[p : p + 20]) for p in at if p + 10 <= len(text)} | {(1, 0): (text[:5], text[:5])}


def test_caps_beyond_a_task_are_ranked_across_tasks(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 0, 0, 1]), r.randrange(3), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "win int, nmiss int, num long").repartition(7)
    for most in (1, 700, 5000):
        got = m._first_across_tasks(df, ["win"], [F.col("nmiss"), F.col("num")], most)
        want = {x for w in (0, 1) for x in sorted(x for x in rows if x[0] == w)[:most]}
        assert {tuple(x) for x in got.select("win", "nmiss", "num").collect()} == want


def test_embedded_reads_of_synthetic_targets_are_found(spark):
    cfg = Config(Windows=(10, 30, 50, 70), WindowWidth=20, MaxReadLength=200).check(files=False)
    found = match(synthetic.generate_reads(spark, 50), prepare_targets(synthetic.generate_targets(spark, 200, 300)), cfg)
    got = {(r.names, r.target, r.pos) for r in found.results.collect()}
    assert {(f"read_{i % 10}", f"target_{i}", i % 10) for i in range(100)} <= got
