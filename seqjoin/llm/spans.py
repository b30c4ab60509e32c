"""Long exact spans that records share.

A record has no lines, so its units are cut by content: of every piece of ``min_len`` bases
the anchor is the ``anchor``-mer of least hash, and neighbouring pieces of one anchor form a
unit.  Equal pieces have equal anchors wherever they stand, so they fall into units of the
same anchor and meet in the group of that anchor's digest, with record and offset retained.

1. Units are cut in numpy, whole batches at once, and travel as compressed blocks per group of
   anchors: some 20 bytes a unit instead of one row per piece.
2. A task goes through its groups one after the other.  It drops units whose anchor is alone,
   then groups units by the digest of their whole text (confirmed on the bases), so that of
   copies only one is looked into.  Distinct units of an anchor are expanded to pieces, whose
   digests are grouped and confirmed alike; out come the intervals that another record holds
   too (or, for ``later``, that an earlier record holds, so that the earliest one is kept).
3. Intervals are merged per record by window functions.

No group of units has to fit into a task's memory.  Anchors that hold a large share of all
units are found beforehand in a count-sketch over all of them; an anchor that proves too large
on arrival is let through.  The pieces of both take another way: they are grouped by the text
of the single piece, combined on the map side; pieces found too frequent for one task are
matched with their lowest and highest record by broadcast, all others by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqjoin.llm.heavy import LEVELS, sketch_hashes
from seqjoin.operators.spread import spread
from seqjoin.scratch import materialize

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.random.default_rng(50).integers(1, 2**64, 256, np.uint64)
MASK = ord("X")
_ZSTD = "zstd"
#: About so many units, some 80 bytes each, make a group that is worked on at once.
UNITS_IN_GROUP = 1 << 17
#: Groups are dealt out to at most so many shuffle partitions; beyond that, each gets several.
MOST_PARTITIONS = 8192
#: A piece with more than this share of all pieces on the second way is looked up by broadcast: at most 4096 of them.
HOT_PIECE = 1 / 4096

def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial hash of every window of ``length`` bytes, by doubling."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, base = _CODE[data], 1, _BASE
    found, done = None, 0
    while span <= length:
        if length & span:
            part = power[done : done + n] if found is not None else power[:n]
            found = part.copy() if found is None else found * base + part
            done += span
        span *= 2
        if span <= length:
            power = power[: len(power) - span // 2] * base + power[span // 2 :]
            base = np.uint64(int(base) ** 2 % 2**64)
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    return found


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def cut_units(data: np.ndarray, min_len: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, pieces, anchor digest) of every unit in ``data``; masked bases part units."""
    if len(data) < min_len:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(window_hashes(data, anchor), min_len - anchor + 1)
    masks = np.concatenate([[0], np.cumsum(data == MASK)])
    starts = np.flatnonzero(masks[min_len:] == masks[:-min_len])
    if not len(starts):
        return starts, starts, least[:0]
    digest = least[starts]
    first = np.concatenate([[True], (np.diff(starts) != 1) | (digest[1:] != digest[:-1])])
    at = np.flatnonzero(first)
    return starts[at], np.diff(np.append(at, len(starts))), digest[at]


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``data[starts[i]:starts[i] + lengths[i]]``, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the second column, whose strings end in a mask each, and their offsets."""
    column = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if (data > 127).any():  # offsets count characters: any of another alphabet masks
        clean = ["".join(c if c < "\x80" else "X" for c in x).encode() for x in batch.column(1).to_pylist()]
        offsets, data = np.concatenate([[0], np.cumsum([len(x) for x in clean])]), np.frombuffer(b"".join(clean), np.uint8)
    return data, offsets - offsets[0]


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of batches cut to about ``most`` bytes; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        data, offsets = _texts(batch)
        begin = 0
        while begin < len(ids):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
            yield ids[begin:end], data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            begin = end


def _pack(ids: np.ndarray, offs: np.ndarray, pieces: np.ndarray, text: np.ndarray) -> bytes:
    """A block of units; ids rise slowly within a task, so their differences pack well."""
    codec = pa.Codec(_ZSTD, 3)
    step = np.diff(ids, prepend=np.int64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T.tobytes()
    parts = [planes, offs.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), pieces.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), text.tobytes()]
    packed = [codec.compress(p, asbytes=True) for p in parts]
    head = np.array([len(ids), len(text), *(len(p) for p in packed)], np.int64)
    return head.tobytes() + b"".join(packed)


def _unpack(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codec = pa.Codec(_ZSTD)
    n, chars, *sizes = np.frombuffer(blob, np.int64, 6).tolist()
    at, out = 48, []
    for size, plain in zip(sizes, (8 * n, 4 * n, 4 * n, chars)):
        out.append(np.frombuffer(codec.decompress(blob[at : at + size], plain, asbytes=True), np.uint8))
        at += size
    ids = np.cumsum(np.ascontiguousarray(out[0].reshape(8, n).T).view(np.int64).ravel())
    offs = np.ascontiguousarray(out[1].reshape(4, n).T).view(np.int32).ravel()
    pieces = np.ascontiguousarray(out[2].reshape(4, n).T).view(np.int32).ravel()
    return ids, offs, pieces, out[3]


_powers: list[np.ndarray] = []


def _range_hashes(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every slice, by differences of a running sum."""
    if not _powers or len(_powers[0]) <= len(data):  # powers of the base and of its inverse, kept for the next call
        base = int(_BASE) | 1
        ones = np.ones(1, np.uint64)
        _powers[:] = [np.concatenate([ones, np.cumprod(np.full(2 * len(data), x, np.uint64))]) for x in (base, pow(base, -1, 2**64))]
    lift, back = _powers
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * back[: len(data)])])
    found = (sums[begin + lengths] - sums[begin]) * lift[begin] + lengths.astype(np.uint64) * _BASE
    found ^= found >> np.uint64(31)
    return found * np.uint64(0xBF58476D1CE4E5B9)


def _classes(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of every unit, unit that stands for each class): units of one class have the same text."""
    digest = _range_hashes(text, begin, lengths)
    while True:
        _, head, of = np.unique(digest, return_index=True, return_inverse=True)
        copies = np.flatnonzero(head[of] != np.arange(len(of)))
        like = head[of[copies]]
        same = lengths[copies] == lengths[like]
        size = np.where(same, lengths[copies], 0)
        differ = gather(text, begin[copies], size) != gather(text, begin[like], size)
        if differ.any():
            same &= np.bincount(np.repeat(np.arange(len(copies)), size)[differ], minlength=len(copies)) == 0
        if same.all():
            return of, head
        digest[copies[~same]] += np.uint64(1)  # two texts of one digest: another digest for the later ones


def _class_intervals(text: np.ndarray, begin: np.ndarray, pieces: np.ndarray, low: np.ndarray, high: np.ndarray, min_len: int, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, start, end in it) of the stretches whose pieces another record (for ``later``: one before the class's lowest) holds too.

    ``low`` and ``high`` are the lowest and highest records of each class.
    """
    of = np.repeat(np.arange(len(begin)), pieces)
    step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = begin[of] + step
    lo, hi = int(begin.min()), int((begin + pieces).max()) + min_len - 1
    order = np.argsort(digest := window_hashes(text[lo:hi], min_len)[at - lo], kind="stable")
    digest, at, of, step = digest[order], at[order], of[order], step[order]
    first = np.concatenate([[True], digest[1:] != digest[:-1]])
    head = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
    equal = np.ones(len(at), bool)
    for j in range(min_len):
        equal &= text[at + j] == text[head + j]
    if not equal.all():  # two texts of one digest: group by the text itself
        words = text[at[:, None] + np.arange(min_len)].copy().view(f"S{min_len}").ravel()
        order = np.argsort(words, kind="stable")
        of, step, words = of[order], step[order], words[order]
        first = np.concatenate([[True], words[1:] != words[:-1]])
    edge, group = np.flatnonzero(first), np.cumsum(first) - 1
    least, most = np.minimum.reduceat(low[of], edge)[group], np.maximum.reduceat(high[of], edge)[group]
    keep = low[of] > least if later else least != most
    of, step = of[keep], step[keep]
    order = np.lexsort((step, of))
    of, step = of[order], step[order]
    if not len(of):
        return of, step, step
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(step) > min_len)]))
    last = np.append(starts[1:], len(of)) - 1
    return of[starts], step[starts], step[last] + min_len


def _shared(ids: np.ndarray, offs: np.ndarray, pieces: np.ndarray, text: np.ndarray, begin: np.ndarray, min_len: int, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, start, end) of what these units share."""
    of, head = _classes(text, begin, pieces + (min_len - 1))
    low, high = np.full(len(head), np.iinfo(np.int64).max), np.full(len(head), np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    cls, a, z = _class_intervals(text, begin[head], pieces[head], low, high, min_len, later)
    # the units of each class, and for each interval of a class all its units
    members = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=len(head))
    first = np.cumsum(size) - size
    unit = members[np.repeat(first[cls], size[cls]) + np.arange(size[cls].sum()) - np.repeat(np.cumsum(size[cls]) - size[cls], size[cls])]
    a, z = np.repeat(a, size[cls]), np.repeat(z, size[cls])
    if later:  # all but the lowest record have the whole unit from an earlier one
        lowest = ids[unit] == low[of[unit]]
        whole = np.flatnonzero(ids > low[of])
        unit = np.concatenate([unit[lowest], whole])
        a = np.concatenate([a[lowest], np.zeros(len(whole), a.dtype)])
        z = np.concatenate([z[lowest], pieces[whole] + (min_len - 1)])
    return ids[unit], offs[unit] + a, offs[unit] + z


def _anchors(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray, min_len: int, anchor: int) -> np.ndarray:
    """The digest of each unit's anchor: the least of its first piece, which is that of all its pieces."""
    digest, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + (2 << 20))))
        lo, hi = begin[at], begin[end - 1] + lengths[end - 1]
        digest[at:end] = sliding_min(window_hashes(text[lo:hi], anchor), min_len - anchor + 1)[begin[at:end] - lo]
        at = end
    return digest


def _match(units: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], min_len: int, anchor: int, later: bool, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shared intervals among units, ``step`` pieces or one anchor at a time."""
    ids, offs, pieces, text = units
    lengths = pieces + (min_len - 1)
    begin = np.cumsum(lengths) - lengths
    digest = _anchors(text, begin, lengths, min_len, anchor)
    order = np.argsort(digest, kind="stable")
    sorted_digest = digest[order]
    first = np.concatenate([[True], sorted_digest[1:] != sorted_digest[:-1]])
    group = np.cumsum(first) - 1
    order = order[np.bincount(group)[group] > 1]
    at, total = 0, np.cumsum(pieces[order])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
        while end < len(order) and digest[order[end]] == digest[order[end - 1]]:
            end += 1
        some = order[at:end]
        part = gather(text, begin[some], lengths[some])
        yield _shared(ids[some], offs[some], pieces[some], part, np.cumsum(lengths[some]) - lengths[some], min_len, later)
        at = end


def _joined(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


def _chosen(units: tuple, which: np.ndarray, min_len: int) -> tuple:
    """Some of the units, in order."""
    ids, offs, pieces, text = units
    lengths = pieces + (min_len - 1)
    begin = np.cumsum(lengths) - lengths
    return ids[which], offs[which], pieces[which], gather(text, begin[which], lengths[which])


class Group:
    """The units of one group of anchors as they arrive; what it gives are record batches of intervals and of single pieces.

    Once more than four times ``most`` units are held, those of anchors with a quarter of
    ``most`` or more leave as pieces, as do all later ones of these anchors.
    """

    def __init__(self, min_len: int, anchor: int, later: bool, most: int):
        self.min_len, self.anchor, self.later, self.most = min_len, anchor, later, most
        self.held: list[tuple] = []
        self.n, self.limit, self.large = 0, 4 * most, np.zeros(0, np.uint64)

    def _digest(self, units: tuple) -> np.ndarray:
        lengths = units[2] + (self.min_len - 1)
        return _anchors(units[3], np.cumsum(lengths) - lengths, lengths, self.min_len, self.anchor)

    def _let_through(self, units: tuple, digest: np.ndarray) -> Iterator[pa.RecordBatch]:
        gone = np.isin(digest, self.large)
        self.held.append(_chosen(units, np.flatnonzero(~gone), self.min_len))
        self.n += len(self.held[-1][0])
        ids, offs, pieces, text = _chosen(units, np.flatnonzero(gone), self.min_len)
        lengths = pieces + (self.min_len - 1)
        begin = np.cumsum(lengths) - lengths
        for i in range(0, len(ids), 1 << 15):
            one = slice(i, i + (1 << 15))
            yield _piece_batch(text, begin[one], pieces[one], ids[one], offs[one], self.min_len)

    def add(self, units: tuple) -> Iterator[pa.RecordBatch]:
        if len(self.large):
            yield from self._let_through(units, self._digest(units))
        else:
            self.held.append(units)
            self.n += len(units[0])
        if self.n > self.limit:
            units = _joined(self.held)
            digest = self._digest(units)
            values, counts = np.unique(digest, return_counts=True)
            self.large = np.union1d(self.large, values[counts >= max(2, self.most // 4)])
            self.held, self.n = [], 0
            yield from self._let_through(units, digest)
            self.limit = max(4 * self.most, 2 * self.n)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            units, self.held = _joined(self.held), []
            for rec, start, end in _match(units, self.min_len, self.anchor, self.later):
                if len(rec):
                    yield pa.record_batch([pa.nulls(len(rec), pa.binary()), pa.array(rec), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], _FOUND)


_FOUND = ["piece", "rec_id", "b", "e"]


def _piece_batch(text: np.ndarray, begin: np.ndarray, pieces: np.ndarray, ids: np.ndarray, offs: np.ndarray, min_len: int) -> pa.RecordBatch:
    """(piece, record, start, null) of every piece of units whose texts begin at ``begin``."""
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(begin, pieces) + step
    bases = pa.FixedSizeBinaryArray.from_buffers(pa.binary(min_len), len(at), [None, pa.py_buffer(gather(text, at, np.full(len(at), min_len)).tobytes())])
    return pa.record_batch([bases.cast(pa.binary()), pa.array(np.repeat(ids, pieces)), pa.array((np.repeat(offs, pieces) + step).astype(np.int64)), pa.nulls(len(at), pa.int64())], _FOUND)


def shared_spans(df: DataFrame, rec_id: str, text: str, *, min_len: int = 50, anchor: int = 31, later: bool = False, partitions: int | None = None) -> DataFrame:
    """(rec_id, span_start, span_len): the maximal runs of bases that other records have too.

    A piece is ``min_len`` neighbouring bases without X; a base counts if it lies in a piece
    that also occurs, at any place, in a record of another ``rec_id`` (with ``later``: of a
    smaller one, so that every piece's earliest record keeps it).  ``rec_id`` is a unique
    BIGINT; rows in which it is null take no part.  Null texts, empty ones and those shorter
    than a piece give no row; a text of any length is worked on whole; characters outside
    ASCII mask like X.  Repeats within one record alone are not shared.
    """
    spark = df.sparkSession
    records = df.select(df[rec_id].cast("long").alias("rec_id"), F.concat(df[text], F.lit("X")).alias("text")).where(
        F.col("rec_id").isNotNull() & (F.length("text") > min_len)
    )
    records = spread(records)
    share = min(1 / 1024, max(UNITS_IN_GROUP / (6 * max(1, df.count())), 1 / (1 << 17)))
    hot, units = _hot_anchors(records, min_len, anchor, share)
    n_groups = max(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // UNITS_IN_GROUP))
    n_parts = partitions or min(n_groups, MOST_PARTITIONS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _blocks(batches):
            start, pieces, digest = cut_units(data, min_len, anchor)
            if len(hot):
                cool = ~np.isin(digest >> np.uint64(64 - LEVELS[-1]), hot)
                start, pieces, digest = start[cool], pieces[cool], digest[cool]
            if not len(start):
                continue
            group = (digest % np.uint64(n_groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            start, pieces, group = start[order], pieces[order], group[order]
            rec = np.searchsorted(offsets, start, "right") - 1
            edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            blobs = []
            for a, b in zip(edges[:-1], edges[1:]):
                one = gather(data, start[a:b], pieces[a:b] + (min_len - 1))
                blobs.append(_pack(ids[rec[a:b]], start[a:b] - offsets[rec[a:b]], pieces[a:b], one))
            group = group[edges[:-1]]
            yield pa.record_batch([pa.array((group % n_parts).astype(np.int32)), pa.array(group), pa.array(blobs, pa.binary())], ["part", "group", "units"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _blocks(batches):
            start, pieces, digest = cut_units(data, min_len, anchor)
            warm = np.isin(digest >> np.uint64(64 - LEVELS[-1]), hot)
            start, pieces = start[warm], pieces[warm]
            rec = np.searchsorted(offsets, start, "right") - 1
            for i in range(0, len(start), 1 << 15):
                some = slice(i, i + (1 << 15))
                yield _piece_batch(data, start[some], pieces[some], ids[rec[some]], start[some] - offsets[rec[some]], min_len)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, group = None, Group(min_len, anchor, later, UNITS_IN_GROUP)
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != number:
                    yield from group.close()
                    number, group = k, Group(min_len, anchor, later, UNITS_IN_GROUP)
                yield from group.add(_unpack(blob.as_buffer()))
        yield from group.close()

    grouped = records.mapInArrow(send, "part int, group long, units binary").repartitionById(n_parts, F.col("part"))
    grouped = grouped.sortWithinPartitions("group").select("group", "units")
    met = grouped.mapInArrow(meet, "piece binary, rec_id long, b long, e long")
    other: list[DataFrame] = []
    if units > 2 * UNITS_IN_GROUP:  # fewer cannot make a group too large
        met = materialize(met, "spans")
        through = met.where("piece IS NOT NULL").select("piece", "rec_id", "b")
        other += [] if through.isEmpty() else [through]
    spans = met.where("piece IS NULL").select("rec_id", "b", "e")
    if len(hot):
        found = records.mapInArrow(single, "piece binary, rec_id long, b long, e long").select("piece", "rec_id", "b")
        other.append(materialize(found, "pieces"))
    if other:
        spans = spans.unionByName(_piecewise(other[0] if len(other) == 1 else other[0].unionByName(other[1]), min_len, later))
    return _islands(spans, rec_id)


def _hot_anchors(records: DataFrame, min_len: int, anchor: int, share: float) -> tuple[np.ndarray, int]:
    """Digest prefixes that may hold ``share`` of all units, at most 4 / share of them; and how many units there are.

    Any beyond that number are found on arrival (see :class:`Group`).
    """
    width_bits = max(13, int(np.ceil(np.log2(4 / share))))
    sketch, total = sketch_hashes(records, 3, width_bits, lambda batches: (cut_units(data, min_len, anchor)[2] for _, data, _ in _blocks(batches)))
    if not total:
        return np.zeros(0, np.uint64), 0
    found, estimates = sketch.heavy(max(2.0, share * total / 2))
    return found[np.argsort(-estimates)][: int(4 / share)], total


def _piecewise(pieces: DataFrame, min_len: int, later: bool, hot_piece: float = HOT_PIECE) -> DataFrame:
    """(rec_id, b, e) of shared pieces among (piece, rec_id, b), grouped piece by piece.

    States are combined on the map side.  A piece in more than ``hot_piece`` of the rows, of
    which there are at most 1 / hot_piece, goes back to its rows by broadcast; the others,
    none of them large, by a join on the piece.
    """
    spark, total = pieces.sparkSession, pieces.count()
    groups = pieces.groupBy("piece").agg(F.min("rec_id").alias("low"), F.max("rec_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    groups = materialize(groups, "pieces")
    many = groups.where(F.col("n") > hot_piece * total).drop("n")
    hot = F.broadcast(spark.createDataFrame(many.collect(), many.schema))  # at most 1 / hot_piece rows
    few = groups.where(F.col("n") <= hot_piece * total).drop("n")
    kept = F.col("rec_id") > F.col("low") if later else F.lit(True)
    at_once = pieces.join(hot, "piece").where(kept)
    rest = pieces.join(hot, "piece", "left_anti").join(few, "piece").where(kept)
    return at_once.unionByName(rest).select("rec_id", "b", (F.col("b") + min_len).alias("e"))


def _islands(spans: DataFrame, rec_id: str) -> DataFrame:
    """Unions of touching intervals per record."""
    before = Window.partitionBy("rec_id").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("rec_id").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spans.withColumn("new", F.when(F.col("b") <= F.max("e").over(before), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(so_far))
        .groupBy("rec_id", "island")
        .agg(F.min("b").alias("b"), F.max("e").alias("e"))
        .select(F.col("rec_id").alias(rec_id), F.col("b").cast("int").alias("span_start"), (F.col("e") - F.col("b")).cast("int").alias("span_len"))
    )
