"""The framed Snappy format: blocks of up to 64 KiB, each with a masked CRC-32C of its plain bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 16
HEAD = b"\xff\x06\x00\x00sNaPpY"


@cache
def _table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = (values >> np.uint32(1)) ^ np.where(values & 1, np.uint32(0x82F63B78), np.uint32(0))
    return values


def checksums(blocks: Sequence[bytes]) -> np.ndarray:
    """The masked CRC-32C of every block; all blocks advance a byte at a time together."""
    if not blocks:
        return np.zeros(0, np.uint32)
    table, sizes = _table(), np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    data = np.zeros((int(sizes.max()), len(blocks)), np.uint8)
    for column, i in enumerate(order):
        data[: sizes[i], column] = np.frombuffer(blocks[i], np.uint8)
    crc = np.full(len(blocks), 0xFFFFFFFF, np.uint32)
    ends = np.searchsorted(-sizes[order], -np.arange(len(data)), "left")  # blocks longer than each place
    for row, n in zip(data, ends):
        crc[:n] = table[(crc[:n] ^ row[:n]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    crc = ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
    found = np.empty(len(blocks), np.uint32)
    found[order] = crc
    return found


def framed(data: bytes) -> bytes:
    """``data`` as frames of a stream, without the stream's head."""
    codec = pa.Codec("snappy")
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    out = []
    for block, crc in zip(blocks, checksums(blocks)):
        body = int(crc).to_bytes(4, "little") + codec.compress(block, asbytes=True)
        out += [b"\x00", len(body).to_bytes(3, "little"), body]
    return b"".join(out)


def _plain_size(body: memoryview) -> int:
    size = shift = 0
    for byte in body[:5]:
        size |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            break
    return size


def blocks_of(data: bytes | pa.Buffer, together: int = 64) -> Iterator[bytes]:
    """The plain blocks of a stream; a checksum that does not hold or a chunk of unknown kind raises ValueError."""
    view, at, codec = memoryview(data).cast("B"), 0, pa.Codec("snappy")
    held: list[bytes] = []
    wanted: list[int] = []

    def checked() -> Iterator[bytes]:
        if (checksums(held) != np.array(wanted, np.uint32)).any():
            raise ValueError("a block of a framed Snappy stream does not fit its checksum")
        yield from held
        held.clear()
        wanted.clear()

    while at + 4 <= len(view):
        kind, size = view[at], int.from_bytes(view[at + 1 : at + 4], "little")
        body = view[at + 4 : at + 4 + size]
        at += 4 + size
        if kind in (0, 1):
            wanted.append(int.from_bytes(body[:4], "little"))
            held.append(bytes(body[4:]) if kind else codec.decompress(bytes(body[4:]), _plain_size(body[4:]), asbytes=True))
            if len(held) == together:
                yield from checked()
        elif kind < 0x80:
            raise ValueError(f"not a framed Snappy stream: chunk of kind {kind}")
    yield from checked()
