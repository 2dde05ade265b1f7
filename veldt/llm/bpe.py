"""Byte-level BPE encoding and decoding.

Each text is split by the public pattern; the merges of a piece depend on the piece alone, so
every distinct piece of a batch is encoded once. Unseen pieces are laid out as padded numpy
matrices by length; in each round every row looks up the ranks of its neighbouring pairs in a
hash table and merges the leftmost pair of least rank, and with it all later pairs of that rank
where no new pair would come between; then the row is compacted. So a long piece takes as many
rounds as it uses ranks, not merges.

Null counts as the empty text, which has no ids. Rows are independent: ties, repeated rows,
extra columns and empty tables need no rule.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, texts_of
from .pieces import Split

#: About so many cells are in a matrix of several rows.
MOST_CELLS = 1 << 16
NONE = np.int32(2**31 - 1)


class PieceCache:
    """Ids of pieces for the tasks of one worker: at most about ``most`` pieces, some megabytes.

    Pieces are known by two hashes. Beyond ``most`` the half goes that was not asked for the longest.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 600_000) -> None:
        self.encode, self.most, self.now = encode, most, 0
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        at = np.cumsum(size) - size + len(self.ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, place, keys), np.insert(self.checks, place, checks)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.used = np.insert(self.used, place, self.now)
        self.ids = np.concatenate([self.ids, ids])

    def _trim(self) -> None:
        keep = np.sort(np.argpartition(-self.used, self.most // 2)[: self.most // 2])
        self.keys, self.checks, at, self.size, self.used = (v[keep] for v in (self.keys, self.checks, self.at, self.size, self.used))
        self.ids = _runs(self.ids, at, self.size)
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size

    def lookup(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids start and end."""
        self.now += 1
        if len(self.keys) > self.most:
            self._trim()
        keys, first, back = np.unique(split.hashes, return_index=True, return_inverse=True)
        known = np.zeros(len(keys), bool)
        place = np.searchsorted(self.keys, keys)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        known |= split.long[first]
        if len(new := np.flatnonzero(~known)):
            self._add(keys[new], split.checks[first[new]], *self.encode([split.piece(i) for i in first[new].tolist()]))
            place = np.searchsorted(self.keys, keys)
        place = np.minimum(place, max(len(self.keys) - 1, 0))
        own = split.long
        at, size, pool = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64), self.ids
        if len(self.keys):
            self.used[place] = self.now
            each = place[back]
            at, size = self.at[each], self.size[each].astype(np.int64)
            own = own | (self.checks[each] != split.checks)
        if len(own := np.flatnonzero(own)):
            ids, size[own] = self.encode([split.piece(i) for i in own.tolist()])
            at[own] = np.cumsum(size[own]) - size[own] + len(pool)
            pool = np.concatenate([pool, ids])
        return _runs(pool, at, size), np.append(0, np.cumsum(size))[split.bounds]


def _apart(hit: np.ndarray) -> np.ndarray:
    """Every other one of hits that stand next to each other, from the left."""
    places = np.arange(hit.shape[1])
    begins = hit.copy()
    begins[:, 1:] &= ~hit[:, :-1]
    begin = np.maximum.accumulate(np.where(begins, places, 0), axis=1)
    return hit & ((places - begin) % 2 == 0)


def _rows(flat: np.ndarray, widths: np.ndarray, fill: int) -> np.ndarray:
    """A matrix of rows of these widths, filled up on the right."""
    wide = int(widths.max())
    if (widths == wide).all():
        return flat.reshape(len(widths), wide)
    out = np.full((len(widths), wide), fill, flat.dtype)
    out[np.arange(wide)[None, :] < widths[:, None]] = flat
    return out


def _runs(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of the pool that start at ``at``, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    source = np.arange(ends[-1] if len(ends) else 0)
    source += np.repeat(at - (ends - size), size)
    return pool[source]


class Merger:
    """Encodes pieces by the ranks of a tiktoken file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            parts = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(word): int(rank) for word, rank in parts}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._hash_pairs()
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.offsets = np.append(0, np.cumsum(self.lengths))
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)

    def _hash_pairs(self) -> None:
        """A table of every pair of ids whose joined bytes have a rank, by open addressing."""
        ranks = self.ranks
        keys, values = [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                left = ranks.get(word[:i])
                right = ranks.get(word[i:]) if left is not None else None
                if right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.found = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slots[slot[left]] == np.uint64(2**64 - 1)]
            self.slots[slot[free]] = key[free]
            won = self.slots[slot[left]] == key[left]
            self.found[slot[left[won]]] = value[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            held = self.slots[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.found[slot[hit]]
            go_on = ~hit & (held != np.uint64(2**64 - 1))
            todo = todo[go_on]
            if not len(todo):
                break
            slot = (slot[go_on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        size = np.zeros(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        size[whole >= 0] = 1
        buckets: dict[int, list[int]] = {}
        for i in np.flatnonzero(whole < 0).tolist():
            buckets.setdefault((len(pieces[i]) + 3) // 4, []).append(i)
        done = []
        for wide, rows in buckets.items():
            step = max(1, MOST_CELLS // (4 * wide + 4))
            for a in range(0, len(rows), step):
                part = np.array(rows[a : a + step])
                ids, size[part] = self._matrix([pieces[i] for i in part])
                done.append((part, ids))
        ends = np.cumsum(size)
        flat = np.zeros(ends[-1] if len(ends) else 0, np.uint32)
        flat[(ends - size)[whole >= 0]] = whole[whole >= 0]
        for part, ids in done:
            n = size[part]
            before = np.cumsum(n) - n
            flat[np.arange(len(ids)) + np.repeat((ends - size)[part] - before, n)] = ids
        return flat, size

    def _matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and how many each has."""
        count = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, count)
        wide = int(size.max(initial=0))
        if wide == 0:
            return np.zeros(0, np.uint32), size
        padded = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(count, wide)
        ids = self.byte_ids[padded]
        ranks = np.full((count, wide), NONE, np.int32)
        y, x = np.nonzero(np.arange(wide - 1)[None, :] < (size - 1)[:, None])
        ranks[y, x] = self.pair_ranks(ids[y, x], ids[y, x + 1])
        done_ids, done_size = ids.copy(), size.copy()
        rows = np.arange(count)
        while len(rows):
            least = ranks.min(axis=1)
            stop = least == NONE
            if stop.any():
                done_ids[rows[stop], : ids.shape[1]], done_size[rows[stop]] = ids[stop], size[stop]
                go_on = ~stop
                rows, ids, ranks, size, least = rows[go_on], ids[go_on], ranks[go_on], size[go_on], least[go_on]
                if not len(rows):
                    break
            hit = ranks == least[:, None]
            again = hit.sum(axis=1) > 1
            if (hit[:, 1:] & hit[:, :-1]).any():
                hit = _apart(hit)
            then = self._merged(ids, ranks, size, least, hit)
            # A new pair of no higher rank would have come before the later ones: such rows merge their leftmost only.
            if (early := again & then[3]).any():
                hit[early] &= hit[early].cumsum(axis=1) == 1
                then = self._merged(ids, ranks, size, least, hit)
            ids, ranks, size = then[:3]
        return done_ids[np.arange(wide)[None, :] < done_size[:, None]].astype(np.uint32), done_size

    def _merged(self, ids: np.ndarray, ranks: np.ndarray, size: np.ndarray, least: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """ids, ranks and sizes after merging the pairs that start at ``hit``; whether a new pair ranks no higher."""
        y, x = np.nonzero(hit)
        count = np.bincount(y, minlength=len(ids))
        # Compact: what stands right of a pair moves left by the pairs before it, padding too.
        stay = np.ones(ids.shape, bool)
        stay[y, x + 1] = False
        at = x - (np.arange(len(y)) - np.repeat(np.cumsum(count) - count, count))
        new_ids, new_ranks = _rows(ids[stay], ids.shape[1] - count, 0), _rows(ranks[stay], ids.shape[1] - count, NONE)
        size = size - count
        new_ids[y, at] = least[y]
        new_ranks[np.arange(len(ids)), size - 1] = NONE
        early = np.zeros(len(ids), bool)
        for first in (at - 1, at):
            ok = (first >= 0) & (first + 1 < size[y])
            r, c = y[ok], first[ok]
            new_ranks[r, c] = told = self.pair_ranks(new_ids[r, c], new_ids[r, c + 1])
            early[r[told <= least[r]]] = True
        return new_ids, new_ranks, size, early

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids between neighbouring edges."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - size), size)
        flat = self.bytes[source].tobytes()
        cuts = np.append(0, ends)[edges].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


@functools.lru_cache(maxsize=1)
def _cache(path: str) -> PieceCache:
    return PieceCache(merger(path).encode)


def encode_texts(
    docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encode and decode the whole text of every row.

    Returns ``doc_id``, ``n_tokens``, ``ids`` (only with ``with_ids``), ``ids_sha256`` over the ids
    as little-endian unsigned 32-bit integers, and ``decoded_sha256`` over the bytes that the ids
    decode to. One narrow pass, no shuffle; a task looks at half a megabyte of text at a time.
    """
    extra = ", ids array<int>" if with_ids else ""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(ranks_path)
        cache = _cache(ranks_path)
        for part in parts(batches, "text"):
            ids, edges = cache.lookup(Split(texts_of(part, "text")))
            decoded = model.decode(ids, edges)
            raw, cuts = ids.astype("<u4").tobytes(), edges.tolist()
            spans = list(zip(cuts, cuts[1:], strict=False))
            columns = [
                part.column(0),
                pa.array(np.diff(edges)),
                pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in spans]),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")


