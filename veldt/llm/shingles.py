"""Weighted word shingles of texts, on numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mix64, span_hashes

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PLACE = np.random.default_rng(5).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """The different shingles of some texts, with their numbers; sorted by text, then hash.

    Words are runs of letters and digits in lower case. A text of fewer words than ``size``, but one
    at least, has one shingle of all its words; a text without words has none.
    """

    def __init__(self, texts: list[str], size: int = 5) -> None:
        raw = "\n".join(texts).lower().encode("utf-8", "replace")
        count = len(texts)
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD_BYTE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        words = span_hashes(data, starts, ends)
        lengths = np.fromiter((len(t.lower().encode("utf-8", "replace")) for t in texts), np.int64, count)
        first_byte = np.cumsum(lengths + 1) - (lengths + 1)
        first = np.append(np.searchsorted(starts, first_byte), len(starts))
        n_words = np.diff(first)
        self.n_words = n_words
        n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        doc = np.repeat(np.arange(count), n_shingles)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[doc]
        last = first[doc + 1]
        padded = np.append(words, np.zeros(size, np.uint64))
        total = np.zeros(len(doc), np.uint64)
        short = n_words[doc] < size
        for j in range(size):
            part = padded[at + j] * _PLACE[j]
            if short.any():
                part[short & (at + j >= last)] = 0
            total += part
        shingle = mix64(total)
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
        where = np.flatnonzero(new)
        self.hashes, self.docs = shingle[where], doc[where]
        self.counts = np.diff(np.append(where, len(doc)))
        #: For each text, the range of its shingles.
        self.bounds = np.searchsorted(self.docs, np.arange(count + 1))
