import csv
import random

import numpy as np
import pyarrow as pa
import pytest

from seqjoin.sources.delimited import BAD, CLOSING, NEXT, PLAIN, QUOTED, START, parse_lines, parse_reads, tokenize, unquoted

SCHEMA = "raw_id long, raw_line string, reason string, read_name string"


def by_hand(line):
    """(first error or -1, ends of fields) by walking one character at a time."""
    state, opened, ends = START, 0, []
    for i, c in enumerate(line):
        before = state
        state = int(NEXT[{",": 1, '"': 2}.get(c, 0), state])
        if state == QUOTED and before == START:
            opened = i
        if state == BAD:
            return i, ends
        if c == "," and state == START:
            ends.append(i)
    return (opened if state == QUOTED else -1), ends


@pytest.mark.parametrize("width", [1, 3, 8, 128])
def test_chunks_compose(width):
    r = random.Random(width)
    lines = ["".join(r.choice('a,"') for _ in range(r.randrange(40))) for _ in range(400)] + ["", '"' + "a," * 5000 + '"', '"' * 9]
    raw = [x.encode() for x in lines]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    bad, count, where, at = tokenize(np.frombuffer(b"".join(raw), np.uint8), offsets, width)
    for i, line in enumerate(lines):
        error, ends = by_hand(line)
        assert bad[i] == error
        if error < 0:
            assert count[i] == len(ends) + 1 and at[where == i].tolist() == ends
            fields = [line[a + 1 : b] for a, b in zip([-1, *ends], [*ends, len(line)])]
            assert unquoted(pa.array(fields, pa.large_string())).to_pylist() == (next(csv.reader([line])) if line else [""])


def test_no_lines():
    bad, count, where, at = tokenize(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(bad) == len(count) == len(where) == len(at) == 0


CASES = [
    ('@a,ACGT,+,FF', None, ("@a", "ACGT")),
    ('"@a ""x"", y","acgtn",+,"F,F"', None, ('@a "x", y', "acgtn")),
    ('@a,ACGT,+,"FF', "quoting", 10),
    ('@a,AC"GT,+,FF', "quoting", 5),
    ('"@a"x,ACGT,+,FF', "quoting", 4),
    ('bad"', "quoting", 3),
    ("@a,ACGT,+", "column_count", None),
    ("@a,ACGT,+,F,F", "column_count", None),
    ("", "column_count", None),
    (None, "column_count", None),
    ("a,ACGT,+,FF", "bad_name", 0),
    ("@ a,ACGT,+,FF", "bad_name", 0),
    ("@,ACGT,+,FF", "bad_name", 0),
    (" @a,ACGT,+,FF", "bad_name", 0),
    ('"",ACGT,+,FF', "bad_name", 0),
    ("@é,AXGT,+,FF", "bad_seq", 3),
    (">a,,+,", "bad_seq", 3),
    ("@a,ACG T,+,FF", "bad_seq", 3),
    ("@long," + "ACGT" * 100_000 + ",+,F", None, ("@long", "ACGT" * 100_000)),
]


def test_reads_and_reasons(spark):
    rows = [(i, line, "old", "old") for i, (line, *_) in enumerate(CASES * 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.raw_id: r for r in parse_reads(df).collect()}
    assert len(got) == len(rows)
    for i, (_, reason, value) in enumerate(CASES * 2):
        r = got[i]
        assert r.reason == reason, CASES[i % len(CASES)][0]
        if reason is None:
            assert (r.read_name, r.seq, r.error_at) == (*value, None)
        else:
            assert (r.read_name, r.seq, r.error_at) == (None, None, value)
    assert parse_reads(df.limit(0)).count() == 0


def test_other_layouts(spark):
    df = spark.createDataFrame([(1, "a,5"), (2, "b,x"), (3, '"c')], "id int, line string")
    got = parse_lines(df, "line", ["id"], ["k", "v"], 2, [("not_a_number", "v", r"^[0-9]+$")], max_bytes=1).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "5", None, None), (2, None, None, "not_a_number", 2), (3, None, None, "quoting", 0)]
    assert CLOSING != PLAIN


def test_batches_that_are_slices():
    """Offsets that do not begin at 0, nulls, and texts of several bytes a character."""
    from seqjoin.sources import delimited

    lines = pa.array(["é" * 9, None, "@é,ACGT,+,FF", '@"', "", "@ü,ÄC,+,F", "@a,ACGT,+,FF"], pa.string()).slice(1)
    data = np.frombuffer(lines.buffers()[2], np.uint8)
    assert len(data) and delimited._cut(pa.py_buffer(b"abcd"), np.array([0, 1, 1, 4])).to_pylist() == ["a", "", "bcd"]
    offsets = np.array([0, 3, 3, 10, 12])
    first = np.array([0, 1, 2, 4])
    small = delimited._classes(np.frombuffer(b'a,bc,"e,f,,"', np.uint8), offsets, first, 5, 4, step=2)
    assert (small == delimited._classes(np.frombuffer(b'a,bc,"e,f,,"', np.uint8), offsets, first, 5, 4)).all()
    assert small.tolist() == [[0, 1, 0, 3], [3, 3, 3, 3], [0, 1, 2, 0], [1, 0, 1, 3], [1, 2, 3, 3]]
