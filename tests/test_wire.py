import gzip
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veldt.sources import wire

text = st.text(st.characters(exclude_categories=["Cs"]), max_size=20)
events = st.tuples(
    text, text, st.integers(-(2**63), 2**63 - 1), st.integers(-(2**31), 2**31 - 1), st.lists(st.lists(text, max_size=3), max_size=3), text, text
)
ONE = ("a" * 64, "b" * 64, 1, 1, [["e", "x"]], "hello", "c" * 128)


@given(st.lists(events, max_size=5))
def test_round_trip(rows):
    raw = b"".join(wire.varint(len(b)) + b for b in map(wire.encode, rows))
    assert [e for _, e in wire.read_events(io.BytesIO(raw))] == [tuple(r) for r in rows]


def test_default_event_is_empty():
    assert wire.encode(("", "", 0, 0, [], "", "")) == b""
    assert [e for _, e in wire.read_events(io.BytesIO(b"\0"))] == [("", "", 0, 0, [], "", "")]


@pytest.mark.parametrize("n", [0, 42, 300, 2**63])
def test_varint(n):
    assert wire.read_varint(io.BytesIO(wire.varint(n))) == n


def test_end_inside_prefix_is_the_end_and_inside_a_body_an_error():
    raw = wire.varint(300)[:1]
    assert list(wire.read_events(io.BytesIO(raw))) == []
    body = wire.encode(ONE)
    with pytest.raises(wire.WireError):
        list(wire.read_events(io.BytesIO(wire.varint(len(body)) + body[:-1])))
    assert list(wire.read_events(io.BytesIO(wire.varint(len(body)) + body[:-1]), strict=False)) == []


def test_broken_record_is_passed_over():
    good = wire.encode(ONE)
    bad = bytearray(good)
    bad[4] = 0xFF
    raw = b"".join(wire.varint(len(b)) + bytes(b) for b in (good, bad, good))
    assert [p for p, _ in wire.read_events(io.BytesIO(raw), strict=False)] == [0, 2]
    with pytest.raises(wire.WireError):
        list(wire.read_events(io.BytesIO(raw)))


def test_prefix_of_more_than_64_bits():
    with pytest.raises(wire.WireError):
        wire.read_varint(io.BytesIO(b"\xff" * 11))


def test_gzip_members():
    raw = wire.compress([ONE]) + wire.compress([ONE, ONE], level=9)
    with gzip.open(io.BytesIO(raw)) as f:
        assert len(list(wire.read_events(f))) == 3
    assert len(wire.compress([ONE] * 100)) * 1.5 < len(wire.encode(ONE)) * 100
