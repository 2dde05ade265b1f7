"""The wire form of events: protobuf fields, length-delimited framing, gzip members.

Fixed values: field numbers 1 to 7 are id, pubkey, created_at, kind, tags, content, sig; a tag's
values are field 1 of a nested message. Default values are not written, so the default event is empty.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

Event = tuple[str, str, int, int, list[list[str]], str, str]
_STRINGS = {1: 0, 2: 1, 6: 5, 7: 6}
_NUMBERS = {3: (2, 64), 4: (3, 32)}


class WireError(ValueError):
    """Bytes that are no framed event."""


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(stream: BinaryIO) -> int | None:
    """The next number; None if the stream ends before it is whole."""
    n = shift = 0
    while byte := stream.read(1):
        n |= (byte[0] & 127) << shift
        if byte[0] < 128:
            return n
        shift += 7
        if shift >= 64:
            raise WireError("a length prefix of more than 64 bits")
    return None


def _field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def encode(event: Event) -> bytes:
    ident, pubkey, created_at, kind, tags, content, sig = event
    out = b"".join(_field(n, t.encode()) for n, t in ((1, ident), (2, pubkey)) if t)
    if created_at:
        out += varint(3 << 3) + varint(created_at)
    if kind:
        out += varint(4 << 3) + varint(kind)
    out += b"".join(_field(5, b"".join(_field(1, v.encode()) for v in tag)) for tag in tags)
    return out + b"".join(_field(n, t.encode()) for n, t in ((6, content), (7, sig)) if t)


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field."""
    stream = io.BytesIO(data)
    while stream.tell() < len(data):
        key = read_varint(stream)
        if key is None or not key >> 3:
            raise WireError("a broken field key")
        wire = key & 7
        if wire == 0:
            value = read_varint(stream)
        elif wire in (1, 5, 2):
            size = {1: 8, 5: 4}.get(wire) or read_varint(stream)
            value = None if size is None else stream.read(size)
            if value is not None and len(value) < size:
                value = None
        else:
            raise WireError(f"wire type {wire}")
        if value is None:
            raise WireError("a field that ends early")
        yield key >> 3, wire, value


def _text(wire: int, value: bytes | int) -> str:
    if wire != 2:
        raise WireError("a number where a string is expected")
    try:
        return value.decode()
    except UnicodeDecodeError as e:
        raise WireError("a string that is not UTF-8") from e


def decode(data: bytes) -> Event:
    out: list = ["", "", 0, 0, [], "", ""]
    for number, wire, value in _fields(data):
        if number in _STRINGS:
            out[_STRINGS[number]] = _text(wire, value)
        elif number in _NUMBERS:
            if wire != 0:
                raise WireError("a string where a number is expected")
            place, bits = _NUMBERS[number]
            value &= (1 << bits) - 1
            out[place] = value - (1 << bits) if value >> (bits - 1) else value
        elif number == 5:
            if wire != 2:
                raise WireError("a tag that is no message")
            out[4].append([_text(w, v) for n, w, v in _fields(value) if n == 1])
    return tuple(out)


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """The framed messages. The end inside a length prefix is the end; inside a body it is an error."""
    while (size := read_varint(stream)) is not None:
        body = stream.read(size)
        if len(body) < size:
            raise WireError("a message that ends early")
        yield body


def read_events(stream: BinaryIO, *, strict: bool = True, report: bool = False) -> Iterator[tuple[int, Event | None]]:
    """(place, event) of a stream of framed events; ``strict`` raises on a broken one.

    Otherwise a broken message is passed over, and the stream is given up where framing or
    compression breaks, as nothing after that can be found. ``report`` gives None for either.
    """
    place = 0
    try:
        for body in frames(stream):
            try:
                yield place, decode(body)
            except WireError:
                if strict:
                    raise
                if report:
                    yield place, None
            place += 1
    except (WireError, EOFError, gzip.BadGzipFile, zlib.error):
        if strict:
            raise
        if report:
            yield place, None


def compress(events: Iterator[Event], level: int = 6) -> bytes:
    """One gzip member of framed events."""
    raw = b"".join(varint(len(b)) + b for b in map(encode, events))
    return gzip.compress(raw, level, mtime=0)
