import random
from collections import Counter, defaultdict

from seqjoin.llm.packing import fill_report, fullest, pack, pack_items, packing_faults
from seqjoin.llm.tokens import count_tokens, encoding, VOCABULARY


def test_fullest_is_optimal():
    r = random.Random(1)
    for _ in range(200):
        counts = Counter(r.randrange(1, 15) for _ in range(7))
        room = r.randrange(1, 40)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        chosen = fullest(room, sorted(counts, reverse=True), counts)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert not Counter(chosen) - counts


def test_items_fit_and_are_split_only_if_too_large():
    r = random.Random(2)
    sizes = [r.choice([0, 1, 5, 90, 100, 101, 1000, r.randrange(60)]) for _ in range(500)]
    held, parts = defaultdict(int), defaultdict(list)
    for item, part, start, size, container in pack_items(sizes, 100):
        held[container] += size
        parts[item].append((part, start, size))
    assert max(held.values()) <= 100
    for i, size in enumerate(sizes):
        got = sorted(parts[i])
        assert sum(s for _, _, s in got) == size and (len(got) == 1 or size > 100)
        assert [p for p, _, _ in got] == list(range(len(got))) and all(a == sum(s for _, _, s in got[:k]) for k, (_, a, _) in enumerate(got))
    assert sum(sizes) / (100 * len(held)) > 0.98


def test_pack_over_shards(spark):
    rows = [(i, (i * 37) % 250 if i % 11 else None, "x", 1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc long, size int, container string, pack_kind int")
    got = pack(df, "doc", "size", [("a", 100), ("b", 300)], shard_items=100)
    for kind, cap in (("a", 100), ("b", 300)):
        mine = [r for r in got.collect() if r.pack_kind == kind]
        assert {r.doc for r in mine} == set(range(600))
        held = Counter()
        for r in mine:
            held[r.container] += r.part_size
        assert max(held.values()) <= cap and sum(held.values()) == sum(s or 0 for _, s, *_ in rows)
    report = {r.pack_kind: r for r in fill_report(got, [("a", 100), ("b", 300)]).collect()}
    assert report["a"].containers >= report["a"].least_containers and report["b"].filled > 0.9
    assert pack(spark.createDataFrame([], df.schema), "doc", "size", [("a", 100)]).count() == 0


def test_token_counts(spark):
    texts = [None, "", "a b  c\n", "Größe 北京 x_1", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in count_tokens(df, "text", ["id"]).collect()}
    enc = encoding(VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_faults_are_seen(spark):
    sized = spark.createDataFrame([(1, 50), (2, 150), (3, 20), (4, None)], "doc long, size int")
    good = pack(sized, "doc", "size", [("a", 100)])
    assert [tuple(r) for r in packing_faults(good, sized, "doc", "size", [("a", 100)]).collect()] == [("a", 4, 0, 0, 0, 0)]
    rows = [("a", 0, 1, 0, 0, 25), ("a", 0, 1, 1, 30, 25), ("a", 0, 2, 0, 0, 100), ("a", 1, 2, 1, 100, 40), ("a", 2, 4, 0, 0, 0)]
    bad = spark.createDataFrame(rows, "pack_kind string, container long, doc long, part_no int, part_start long, part_size long")
    assert [tuple(r) for r in packing_faults(bad, sized, "doc", "size", [("a", 100)]).collect()] == [("a", 4, 1, 2, 1, 1)]
