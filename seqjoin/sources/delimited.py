"""Delimited lines, taken apart by a quote-aware finite-state tokenizer.

Fields are parted by commas.  A field whose first character is a quote runs to the closing
quote; inside it commas are data and a quote is written twice.  Nothing is trimmed.

The tokenizer works on whole batches of lines at once.  Lines are cut into chunks of equal
width; of every chunk the map "state before -> state after" is computed for all states side
by side, the maps of one line's chunks are composed by a prefix scan, and a second walk from
the now known states yields field ends and the place of the first error.  A line of many
megabytes thus costs as many vector steps as a short one.  Fields are cut out of the batch's
own buffer as Arrow arrays and checked by vectorized patterns; no row is handled singly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seqjoin.operators.spread import spread

START, PLAIN, QUOTED, CLOSING, BAD = range(5)
OTHER, COMMA, QUOTE, NONE = range(4)
#: State after each class of character (rows) in each state (columns); NONE is padding.
NEXT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BAD, BAD],
        [START, START, QUOTED, START, BAD],
        [QUOTED, BAD, CLOSING, QUOTED, BAD],
        [START, PLAIN, QUOTED, CLOSING, BAD],
    ],
    np.uint8,
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord(",")], _CLASS[ord('"')] = COMMA, QUOTE


def compose(maps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Prefix composition of chunk maps (n, 5) within lines; ``place`` is the chunk's index in its line."""
    maps, step = maps.copy(), 1
    while step <= place.max(initial=0):
        later = np.flatnonzero(place >= step)
        maps[later] = np.take_along_axis(maps[later], maps[later - step], axis=1)
        step *= 2
    return maps


def _classes(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, n_chunks: int, width: int, step: int = 1 << 20) -> np.ndarray:
    """Classes of all characters, each line padded to whole chunks; temporary memory is that of ``step`` bytes."""
    classes = np.full(n_chunks * width, NONE, np.uint8)
    shift = first * width - offsets[:-1]
    for a in range(0, len(data), step):
        z = min(a + step, len(data))
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, z, "left"))
        within = np.minimum(offsets[i + 1 : j + 1], z) - np.maximum(offsets[i:j], a)
        classes[np.arange(a, z) + np.repeat(shift[i:j], within)] = _CLASS[data[a:z]]
    return classes.reshape(n_chunks, width)


def tokenize(data: np.ndarray, offsets: np.ndarray, width: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take apart the lines ``data[offsets[i]:offsets[i + 1]]`` (bytes).

    Returns, per line, the byte of the first quoting error (-1 if none; for a field left
    open, its opening quote) and the number of fields; and, over all lines, the line and the
    byte in the line of every comma that ends a field, in order.
    """
    lengths = np.diff(offsets)
    chunks = np.maximum(1, -(-lengths // width))
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]]).astype(np.int64)
    line = np.repeat(np.arange(len(lengths)), chunks)
    place = np.arange(len(line)) - first[line]
    classes = _classes(data, offsets, first, len(line), width)

    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (len(line), 5)).copy()
    for j in range(width):
        maps = NEXT[classes[:, j, None], maps]
    after = compose(maps, place)
    state = np.where(place == 0, START, np.roll(after[:, START], 1)).astype(np.uint8)

    bad_at, opened = np.full(len(lengths), -1, np.int64), np.full(len(lengths), -1, np.int64)
    commas: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(width):
        before, state = state, NEXT[classes[:, j], state]
        broke = np.flatnonzero((state == BAD) & (before != BAD))
        bad_at[line[broke]] = place[broke] * width + j
        quote = np.flatnonzero((state == QUOTED) & (before == START))
        np.maximum.at(opened, line[quote], place[quote] * width + j)  # the last one of the line stays
        comma = np.flatnonzero((classes[:, j] == COMMA) & (state == START))
        commas.append((line[comma], place[comma] * width + j))
    still_open = after[first + chunks - 1, START] == QUOTED if len(lengths) else np.zeros(0, bool)
    bad_at = np.where(still_open, opened, bad_at)
    comma_line, comma_at = (np.concatenate(x) for x in zip(*commas))
    order = np.lexsort((comma_at, comma_line))
    return bad_at, np.bincount(comma_line, minlength=len(lengths)) + 1, comma_line[order], comma_at[order]


def _cut(data: pa.Buffer, edges: np.ndarray) -> pa.Array:
    """The stretches between neighbouring edges of a text buffer, without a copy."""
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), data)


def unquoted(fields: pa.Array) -> pa.Array:
    """The values of fields that the tokenizer accepted."""
    quoted = pc.starts_with(fields, pattern='"')
    if not pc.any(quoted).as_py():
        return fields
    inner = pc.replace_substring(pc.utf8_slice_codeunits(fields, 1, -1), pattern='""', replacement='"')
    return pc.if_else(quoted, inner, fields)


def parse_lines(
    df: DataFrame,
    line: str,
    keep: Sequence[str],
    columns: Sequence[str],
    n_fields: int,
    checks: Sequence[tuple[str, str, str]] = (),
    max_bytes: int = 4 << 20,
) -> DataFrame:
    """Every row of ``df`` as loaded fields or as the reason why not.

    The result has the columns ``keep``, then ``columns`` (STRING; the first fields of the
    line, null in rejected rows), ``reason`` (null in loaded rows) and ``error_at`` (0-based
    character of the line, null where no place can be named).  Reasons, the first that holds:
    ``quoting``, ``column_count`` (not ``n_fields`` fields; also null lines), then those of
    ``checks``: (reason, column, pattern, in RE2 syntax, that its value has to hold).  An empty line has one empty field.
    Nothing is dropped: repeated lines give a row each, an empty table an empty result.
    """
    keep, columns = list(keep), list(columns)
    fields = [df.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{c}` string" for c in columns), "reason string", "error_at int"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch, max_bytes):
                if part.num_rows:
                    yield _parsed(part)

    def _by_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
        if batch.num_rows <= 1 or batch.column(len(keep)).nbytes <= most:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from _by_bytes(batch.slice(0, half), most)
            yield from _by_bytes(batch.slice(half), most)

    def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(len(keep))
        null = pc.is_null(text).to_numpy(zero_copy_only=False)
        whole = pc.fill_null(text, "").cast(pa.large_string())
        _, where, buffer = whole.buffers()
        offsets = np.frombuffer(where, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        buffer = pa.py_buffer(b"") if buffer is None else buffer
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
        bad_at, count, comma_line, comma_at = tokenize(data, offsets - offsets[0])
        comma = offsets[comma_line] + comma_at
        # every field and every comma between two is a stretch of the buffer
        fields = _cut(buffer, np.sort(np.concatenate([offsets, comma, comma + 1])))
        first = np.concatenate([[0], np.cumsum(2 * count - 1)[:-1]]) if len(count) else count
        first_comma = np.searchsorted(comma_line, np.arange(len(count)))

        reason = np.full(len(count), -1, np.int64)
        place = np.full(len(count), -1, np.int64)
        reason[(count != n_fields) | null] = 1
        reason[bad_at >= 0], place[bad_at >= 0] = 0, bad_at[bad_at >= 0]
        sound = np.flatnonzero(reason < 0)
        got = [unquoted(fields.take(pa.array(first[sound] + 2 * k))) for k in range(len(columns))]
        left = np.ones(len(sound), bool)
        for number, (_, column, pattern) in enumerate(checks, 2):
            k = columns.index(column)
            fails = left & ~pc.match_substring_regex(got[k], pattern=pattern).to_numpy(zero_copy_only=False)
            left &= ~fails
            lines = sound[fails]
            reason[lines] = number
            place[lines] = comma_at[first_comma[lines] + k - 1] + 1 if k else 0
        spots = np.flatnonzero(place >= 0)  # bytes become characters
        ahead = _cut(buffer, np.append(np.stack([offsets[spots], offsets[spots] + place[spots]], 1).ravel(), offsets[-1]))
        place[spots] = pc.utf8_length(ahead.take(pa.array(np.arange(0, 2 * len(spots), 2)))).to_numpy(zero_copy_only=False)
        back = np.full(len(count), -1, np.int64)
        back[sound[left]] = np.flatnonzero(left)
        values = [x.take(pa.array(back, pa.int64(), mask=back < 0)).cast(pa.string()) for x in got]
        reasons = pa.array(["quoting", "column_count", *(c[0] for c in checks)], pa.string())
        arrays = [batch.column(k) for k in range(len(keep))] + values
        arrays += [reasons.take(pa.array(reason, pa.int64(), mask=reason < 0)), pa.array(place.astype(np.int32), pa.int32(), mask=place < 0)]
        return pa.record_batch(arrays, [*keep, *columns, "reason", "error_at"])

    return spread(df.select(*keep, df[line].cast("string").alias("__line"))).mapInArrow(parse, schema)


def parse_reads(df: DataFrame, line: str = "raw_line", keep: Sequence[str] = ("raw_id",)) -> DataFrame:
    """Lines of four fields (name, sequence, plus line, quality) as reads or reasons; see :func:`parse_lines`.

    ``bad_name``: the name is not ``@`` or ``>`` followed at once by a non-blank character.
    ``bad_seq``: the sequence is empty or holds anything but A, C, G, T, N in either case.
    """
    return parse_lines(df, line, keep, ["read_name", "seq"], 4, [("bad_name", "read_name", r"^[@>]\S"), ("bad_seq", "seq", r"^[ACGTNacgtn]+$")])
