import random

import numpy as np
import pytest

from seqjoin.llm import spans
from seqjoin.llm.spans import _pack, _unpack, cut_units, shared_spans, window_hashes

SCHEMA = "id long, text string, part int, b int, rec_id int"


def brute(texts, k, later=False):
    seen = {}
    for i, t in texts:
        for p in range(len(t or "") - k + 1):
            seen.setdefault(t[p : p + k], set()).add(i)
    out = set()
    for i, t in texts:
        covered = set()
        for p in range(len(t or "") - k + 1):
            piece = t[p : p + k]
            if "X" in piece or any(ord(c) > 127 for c in piece):
                continue
            if (min(seen[piece]) < i) if later else seen[piece] - {i}:
                covered.update(range(p, p + k))
        for p in sorted(covered):
            if p - 1 not in covered:
                e = p
                while e in covered:
                    e += 1
                out.add((i, p, e - p))
    return out


def data(seed):
    r = random.Random(seed)
    base = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    stock = [base(60) for _ in range(4)] + ["A" * 70, "CA" * 40, base(30) + "X" + base(30)]
    texts = []
    for i in range(150):
        t = base(r.randrange(30))
        for _ in range(r.randrange(4)):
            s = r.choice(stock)
            t += s[r.randrange(20) : len(s) - r.randrange(20)] + base(r.randrange(25))
        texts.append((i * 7, t))
    return texts + [(5000, None), (5001, ""), (5002, "é" + base(60)), (5003, stock[0] * 40), (5004, stock[0] * 40)]


def rows(texts):
    return [(i, t, 1, 2, 3) for i, t in texts]


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("k,anchor", [(50, 31), (20, 12)])
def test_against_brute_force(spark, k, anchor, later):
    texts = data(k)
    got = shared_spans(spark.createDataFrame(rows(texts), SCHEMA).repartition(5), "id", "text", min_len=k, anchor=anchor, later=later)
    assert {tuple(r) for r in got.collect()} == brute(texts, k, later)


def test_hot_anchors_take_the_other_way(spark, monkeypatch):
    texts = data(9)
    found = spans._hot_anchors
    monkeypatch.setattr(spans, "_hot_anchors", lambda *a: found(*a[:3], 1 / 200))
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    records = df.selectExpr("id AS rec_id", "concat(text, 'X') AS text").where("text IS NOT NULL")
    assert len(found(records, 50, 31, 1 / 200)[0]) > 0
    for later in (False, True):
        assert {tuple(r) for r in shared_spans(df, "id", "text", later=later).collect()} == brute(texts, 50, later)


@pytest.mark.parametrize("later", [False, True])
def test_large_anchors_are_let_through_on_arrival(spark, monkeypatch, later):
    """A block that a third of all records share, found only when its group runs full, is matched piece by piece."""
    r = random.Random(3)
    block = "".join(r.choice("ACGT") for _ in range(60))
    texts = [(i, ("".join(r.choice("ACGT") for _ in range(40)) + block if i % 3 == 0 else "".join(r.choice("ACGT") for _ in range(80)))) for i in range(300)]
    texts += [(i, t) for i, t in data(5) if i not in dict(texts)]
    sizes = []
    let = spans.Group._let_through
    monkeypatch.setattr(spans, "UNITS_IN_GROUP", 40)
    monkeypatch.setattr(spans, "_hot_anchors", lambda *a: (np.zeros(0, np.uint64), 10_000))
    group = spans.Group(50, 31, later, 40)
    for i in range(0, len(texts), 20):
        ids, plain = zip(*[(i, (t or "") + "X") for i, t in texts[i : i + 20]])
        text = np.frombuffer("".join(x if x.isascii() else "X" for x in plain).encode(), np.uint8)
        ends = np.cumsum([len(x) if x.isascii() else 1 for x in plain])
        start, pieces, _ = cut_units(text, 50, 31)
        rec = np.searchsorted(ends, start, "right")
        lengths = pieces + 49
        for b in group.add((np.array(ids)[rec], start - (ends - [len(x) if x.isascii() else 1 for x in plain])[rec], pieces, spans.gather(text, start, lengths))):
            sizes.append(b.num_rows)
        assert group.n <= group.limit
    assert sum(sizes) > 300 and let is spans.Group._let_through
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(5)
    assert {tuple(r) for r in shared_spans(df, "id", "text", later=later, partitions=2).collect()} == brute(texts, 50, later)


def test_hot_pieces_go_back_by_broadcast(spark):
    rows = [(b"hot", i, 0) for i in range(400)] + [(b"p%d" % (i // 2), i, 5) for i in range(300)] + [(b"alone", 7, 0)] * 3
    df = spark.createDataFrame(rows, "piece binary, rec_id long, b long").repartition(4)
    for later in (False, True):
        want = sorted((i, b, b + 50) for p, i, b in rows if p != b"alone" and not (later and (p == b"hot" and i == 0 or p != b"hot" and i % 2 == 0)))
        for share in (0.0, 0.01, 1.0):
            assert sorted(map(tuple, spans._piecewise(df, 50, later, share).collect())) == want


def test_equal_units_are_one_class():
    text = np.frombuffer(b"ACGTACGTAACGTAACGTACG", np.uint8)
    of, head = spans._classes(text, np.array([0, 4, 8, 13, 17]), np.array([4, 4, 5, 4, 4]))
    assert len(head) == len(set(of.tolist())) == 4 and of[0] == of[1]


def test_empty_and_null_ids(spark):
    assert shared_spans(spark.createDataFrame([], SCHEMA), "id", "text").count() == 0
    same = "ACGTTGCA" * 10
    df = spark.createDataFrame([(None, same, 1, 1, 1), (1, same, 1, 1, 1)], SCHEMA)
    assert shared_spans(df, "id", "text").count() == 0


def test_blocks_round_trip_and_hashes():
    r = np.random.default_rng(1)
    ids, offs, pieces = np.sort(r.integers(-(2**60), 2**60, 50)), r.integers(0, 99, 50), r.integers(1, 20, 50)
    text = r.integers(65, 70, int((pieces + 49).sum())).astype(np.uint8)
    for a, b in zip((ids, offs, pieces, text), _unpack(memoryview(_pack(ids, offs, pieces, text)))):
        assert (a == b).all()
    data = r.integers(65, 69, 300).astype(np.uint8)
    for k in (1, 2, 3, 31, 50, 64):
        h = window_hashes(data, k)
        assert len(h) == 300 - k + 1
        assert len(set(zip(h.tolist(), (data[i : i + k].tobytes() for i in range(len(h)))))) == len(set(h.tolist()))
    start, pieces, _ = cut_units(data, 50, 31)
    assert pieces.sum() == 251 and start[0] == 0
