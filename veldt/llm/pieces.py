"""Splitting texts by the public byte-level BPE pattern, on numpy arrays.

The pattern (see ``public_tokenizers.PATTERN``) takes, at each place, a contraction after an
apostrophe, else an optional space and a run of letters, digits or other signs, else white
space, leaving the last white space before a sign to what follows. Written as rules on where a
piece starts, that needs no scan character by character.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from .common import OTHER_POWERS, span_hashes

LETTER, DIGIT, SIGN, SPACE = 1, 2, 3, 0
#: Pieces above so many characters are never looked up by their hash.
LONG = 512


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, from the properties that the pattern names."""
    table = np.full(0x110000, SIGN, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(rule, every):
            table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    return table


class Split:
    """The pieces of some texts: their code points, byte spans, hashes and documents."""

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(texts)
        self.utf8 = joined.encode("utf-8")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=edges[1:])
        n = len(points)
        self.starts = piece_starts(points, edges[:-1][lengths > 0]) if n else np.zeros(0, np.int64)
        ends = np.append(self.starts[1:], n) if n else self.starts
        #: For each text, the range of its pieces.
        self.bounds = np.searchsorted(self.starts, edges)
        #: Two hashes over different bases: pieces that agree in both are taken as equal.
        self.hashes = span_hashes(points, self.starts, ends) if n else np.zeros(0, np.uint64)
        self.checks = span_hashes(points, self.starts, ends, OTHER_POWERS) if n else np.zeros(0, np.uint64)
        self.long = (ends - self.starts) > LONG
        if len(self.utf8) == n:
            self.byte_starts, self.byte_ends = self.starts, ends
        else:
            width = np.ones(n, np.int64)
            for least in (0x80, 0x800, 0x10000):
                width += points >= least
            offset = np.zeros(n + 1, np.int64)
            np.cumsum(width, out=offset[1:])
            self.byte_starts, self.byte_ends = offset[self.starts], offset[ends]

    def piece(self, i: int) -> bytes:
        return self.utf8[self.byte_starts[i] : self.byte_ends[i]]


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start; ``firsts`` are the places where a text starts."""
    n = len(points)
    kind = classes()[points]
    blank = kind == SPACE
    new_text = np.zeros(n, bool)
    new_text[firsts] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= new_text
    after_space = np.zeros(n, bool)
    np.equal(points[:-1], 32, out=after_space[1:])
    after_space &= ~new_text
    start = run & (blank | ~after_space)
    # The last white space before a sign of the same text starts a piece.
    start[:-1] |= blank[:-1] & ~blank[1:] & ~new_text[1:]
    quotes = np.flatnonzero((points == 39) & run & ~after_space)
    if len(quotes):
        _contractions(points, new_text, quotes, start)
    return np.flatnonzero(start)


def _contractions(points: np.ndarray, new_text: np.ndarray, quotes: np.ndarray, start: np.ndarray) -> None:
    n = len(points)

    def at(k: int) -> np.ndarray:
        """The character k places on, or 0 beyond the text."""
        where = np.minimum(quotes + k, n - 1)
        inside = quotes + k < n
        for j in range(1, k + 1):
            inside &= ~new_text[np.minimum(quotes + j, n - 1)]
        return np.where(inside, points[where], 0)

    one, two = at(1), at(2)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where((size == 0) & (one == ord(a)) & (two == ord(b)), 3, size)
    hit = size > 0
    quotes, size = quotes[hit], size[hit]
    start[quotes + 1] = False
    three = quotes[size == 3]
    start[three + 2] = False
    stop = quotes + size
    start[stop[stop < n]] = True
