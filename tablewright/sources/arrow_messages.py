"""Places of the messages in an Arrow file, found without reading their bodies.

A stream is a row of messages: a length, a small description, a body. A random-access
file holds the same messages between a mark and an index. Walking over lengths and
descriptions alone therefore gives the place of every record batch in both, and a
part of the file can be read as a stream of its own: the schema, the dictionaries
that come before the part, and the part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

# Marks of the framing and numbers of the kinds of message.
FILE_MAGIC = b"ARROW1"
CONTINUATION = b"\xff\xff\xff\xff"
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
# Places of fields in the description of a message and of a batch.
_KIND, _HEADER, _BODY = 1, 2, 3
_ROWS = 0


class Message(NamedTuple):
    kind: int
    offset: int
    size: int
    rows: int  # of a record batch, else 0


class DamagedFile(ValueError):
    """An Arrow file whose messages cannot be followed from the place ``at`` on."""

    def __init__(self, reason: str, at: int = 0) -> None:
        super().__init__(reason)
        self.at = at


def _number(buffer: bytes, kind: str, at: int) -> int:
    return struct.unpack_from(f"<{kind}", buffer, at)[0]


def _field(buffer: bytes, table: int, index: int) -> int | None:
    """Where a field of a table in the description lies; None where it has its default."""
    fields = table - _number(buffer, "i", table)
    slot = 4 + 2 * index
    if slot >= _number(buffer, "H", fields):
        return None
    distance = _number(buffer, "H", fields + slot)
    return table + distance if distance else None


def _described(buffer: bytes) -> tuple[int, int, int]:
    """Kind, bytes of body and rows of the message that the description is of."""
    table = _number(buffer, "I", 0)
    kind, header, body = (_field(buffer, table, i) for i in (_KIND, _HEADER, _BODY))
    kind = _number(buffer, "B", kind) if kind else 0
    rows = None
    if kind == BATCH and header:
        rows = _field(buffer, header + _number(buffer, "I", header), _ROWS)
    return kind, _number(buffer, "q", body) if body else 0, _number(buffer, "q", rows) if rows else 0


def _bounds(source: pa.NativeFile, size: int) -> tuple[int, int]:
    """Where the messages begin and where they end at the latest."""
    source.seek(0)
    if source.read(len(FILE_MAGIC)) != FILE_MAGIC:
        return 0, size
    tail = len(FILE_MAGIC) + 4
    if size < 8 + tail:
        raise DamagedFile("the file ends before its index")
    source.seek(size - tail)
    end = source.read(tail)
    index = _number(end, "i", 0)
    if end[4:] != FILE_MAGIC or not 0 < index <= size - tail - 8:
        raise DamagedFile("the file has no index")
    return 8, size - tail - index


def messages(source: pa.NativeFile, size: int | None = None) -> Iterator[Message]:
    """Every message of a file in order; ``size`` is that of the file."""
    size = source.size() if size is None else size
    at, end = _bounds(source, size)
    if at >= end:
        raise DamagedFile("the file holds no message")
    while at < end:
        source.seek(at)
        prefix = source.read(8)
        if len(prefix) < 4:
            raise DamagedFile(f"the file ends within the message at {at}", at)
        long = prefix[:4] == CONTINUATION  # older files have the length alone
        head = 8 if long else 4
        if long and len(prefix) < 8:
            raise DamagedFile(f"the file ends within the message at {at}", at)
        length = _number(prefix, "i", head - 4)
        if length == 0:
            return
        if length < 0 or at + head + length > end:
            raise DamagedFile(f"there is no message at {at}", at)
        source.seek(at + head)
        try:
            kind, body, rows = _described(source.read(length))
        except struct.error as error:
            raise DamagedFile(f"there is no message at {at}", at) from error
        whole = head + length + body
        if body < 0 or at + whole > end:
            raise DamagedFile(f"the file ends within the message at {at}", at)
        yield Message(kind, at, whole, rows)
        at += whole


class Extents:
    """Several parts of a file as one readable stream."""

    def __init__(self, source: pa.NativeFile, extents: list[tuple[int, int]]) -> None:
        self._source = source
        self._left = [list(e) for e in reversed(extents)]
        self.closed = False

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.closed = True

    def read(self, size: int = -1) -> bytes:
        parts = []
        while self._left and size:
            offset, left = self._left[-1]
            self._source.seek(offset)
            part = self._source.read(left if size < 0 else min(left, size))
            if not part:
                break
            parts.append(part)
            size -= len(part) if size > 0 else 0
            if len(part) == left:
                self._left.pop()
            else:
                self._left[-1] = [offset + len(part), left - len(part)]
        return b"".join(parts)


def batches_of(source: pa.NativeFile, before: list[tuple[int, int]], low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The record batches from ``low`` to ``high``; ``before`` has the places of the schema and of earlier dictionaries."""
    yield from pa.ipc.open_stream(pa.PythonFile(Extents(source, [*before, (low, high - low)]), mode="r"))
