"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A packing of integer sizes depends only on how many pieces have each size. So the pieces are
counted by size (a table of at most ``capacity`` rows, the only thing that the driver sees),
the bins are planned on those counts as runs of equal bins, and every piece finds its place
from its rank among the pieces of its size. Nothing is sampled and no task gathers a size.

The plan: pieces above a third of the capacity go at most two to a bin, each matched greedily
with the largest partner that still fits; smaller ones, by falling size, go to the smallest gap
that takes them, and open bins only when no gap does.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PieceCache
from .common import cut, parts, texts_of
from .pieces import Split


@dataclass
class Plan:
    """Runs of bins: ``entries`` are (size, first bin, bins, pieces of that size in each, offset)."""

    capacity: int
    entries: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0

    def open(self, count: int) -> int:
        first, self.bins = self.bins, self.bins + count
        return first


def plan_bins(counts: dict[int, int], capacity: int) -> Plan:
    """Plan bins for ``counts[size]`` pieces of each size. At most a few entries for each size."""
    plan = Plan(capacity)
    left = {s: n for s, n in counts.items() if n > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(size: int, first: int, bins: int, each: int, gap: int) -> None:
        plan.entries.append((size, first, bins, each, capacity - gap))
        if bins and (rest := gap - each * size):
            gaps.setdefault(rest, []).append((first, bins))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while n := left.get(size, 0):
            partner = next((s for s in large if s <= min(size, capacity - size) and left.get(s, 0) > (s == size)), None)
            if partner is None:
                put(size, plan.open(n), n, 1, capacity)
                left[size] = 0
            elif partner == size:
                put(size, plan.open(n // 2), n // 2, 2, capacity)
                left[size] = n % 2
            else:
                pairs = min(n, left[partner])
                first = plan.open(pairs)
                plan.entries.append((size, first, pairs, 1, 0))
                put(partner, first, pairs, 1, capacity - size)
                left[size] -= pairs
                left[partner] -= pairs
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            gap = min((g for g, runs in gaps.items() if g >= size and runs), default=None)
            if gap is None:
                each = capacity // size
                if n >= each:
                    put(size, plan.open(n // each), n // each, each, capacity)
                if n % each:
                    put(size, plan.open(1), 1, n % each, capacity)
                break
            first, bins = gaps[gap].pop()
            each = gap // size
            full = min(bins, n // each)
            if full:
                put(size, first, full, each, gap)
            n -= full * each
            first, bins = first + full, bins - full
            if bins and 0 < n < each:
                put(size, first, 1, n, gap)
                first, bins, n = first + 1, bins - 1, 0
            if bins:
                gaps[gap].append((first, bins))
    return plan


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return model


def encode_pieces(path: str):
    """Ids of single pieces by the tokenizers library; the pattern leaves a piece whole.

    Pieces of a space and a sign of another kind are put behind each other, as the pattern parts them
    there again: one call for many costs less than one for each.
    """
    model = _tokenizer(path)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.decode() for p in pieces]
        size = np.zeros(len(words), np.int64)
        joined = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        single = np.setdiff1d(np.arange(len(words)), joined).tolist()
        found = [np.zeros(0, np.uint32)]
        for a in range(0, len(joined), 256):
            own = joined[a : a + 256]
            told = model.encode("".join([words[i] for i in own]), add_special_tokens=False)
            size[own] = np.bincount(np.array(told.word_ids), minlength=len(own))
            found.append(np.array(told.ids, np.uint32))
        for a in range(0, len(single), 256):
            own = single[a : a + 256]
            made = [e.ids for e in model.encode_batch_fast([words[i] for i in own], add_special_tokens=False)]
            size[own] = np.fromiter(map(len, made), np.int64, len(made))
            found.append(np.array([i for ids in made for i in ids], np.uint32))
        order = np.array([*joined, *single], np.int64)
        n, ends = size[order], np.cumsum(size)
        flat = np.zeros(ends[-1] if len(ends) else 0, np.uint32)
        flat[np.arange(len(flat)) + np.repeat((ends - size)[order] - (np.cumsum(n) - n), n)] = np.concatenate(found)
        return flat, size

    return encode


@functools.lru_cache(maxsize=1)
def added_tokens(path: str) -> tuple[re.Pattern, dict[str, int]] | None:
    """What finds the added tokens of the file in a text, and their ids; the longest of those that start together wins."""
    tokens = _tokenizer(path).get_added_tokens_decoder()
    if not tokens:
        return None
    if odd := [t.content for t in tokens.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]:
        raise ValueError(f"added tokens that take white space, want word borders or normalised text are not supported: {odd}")
    ids = {t.content: i for i, t in tokens.items()}
    return re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))), ids


def encode_whole(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after another, and where each text's ids start.

    Added tokens cut a text into parts that the pattern never sees together; their ids stand between.
    """
    cache, added = _cache(path), added_tokens(path)
    if added is None or not any(added[0].search(t) for t in texts):
        return cache.lookup(Split(texts))
    rule, known = added
    parts, firsts, between = [], [0], []
    for text in texts:
        at = 0
        for m in rule.finditer(text):
            parts.append(text[at : m.start()])
            between.append((len(parts), known[m.group()]))
            at = m.end()
        parts.append(text[at:])
        firsts.append(len(parts))
    ids, edges = cache.lookup(Split(parts))
    after = np.array([k for k, _ in between])
    whole = np.insert(ids, edges[after], np.array([i for _, i in between], ids.dtype))
    return whole, edges[firsts] + np.searchsorted(after, firsts, side="right")


@functools.lru_cache(maxsize=1)
def _cache(path: str) -> PieceCache:
    return PieceCache(encode_pieces(path))


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with its task and its number among the pieces of its size in that task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in parts(batches, "text"):
            ids, edges = encode_whole(texts_of(part, "text"), tokenizer_path)
            count = part.num_rows
            total = np.diff(edges) + 1
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(count), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = total - (pieces - 1) * capacity
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            length = np.where(number == 0, first[row], capacity)
            # Room for the end id after each document.
            flat = np.full(len(ids) + count, end_id, "<u4")
            flat[np.arange(len(ids)) + np.repeat(np.arange(count), np.diff(edges))] = ids
            raw, at = memoryview(flat.tobytes()), (edges[:-1] + np.arange(count))[row] + start
            crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes, own = np.unique(length, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(seen[sizes], own)
            seen[sizes] += own
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(np.array(crc, np.int64)),
                    pa.array(np.full(len(row), task, np.int64)),
                    pa.array(rank),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise, cut and pack documents.

    A document is its ids and then ``end_id``; only longer ones than ``capacity`` are cut, into
    pieces of ``capacity`` of which the first may be shorter. Returns per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id and offset. Null and empty texts are the end id alone.
    Repeated rows are packed as often as they stand there; other columns are not read; an empty
    table gives no rows. The pieces (without ids) are written once to the shared folder, so that
    the ranks that tasks gave stay what they are when executors are lost.
    """
    pieces = cut(cut_documents(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    # Positions of all pieces by size and then rank; each entry of the plan takes a range of them.
    bases, at = {}, 0
    for size in sorted(counts):
        bases[size] = at
        at += counts[size]
    entries = sorted(plan.entries)
    taken = np.array([e[2] * e[3] for e in entries], np.int64)
    ends = np.cumsum(taken)
    spec = np.array(entries, np.int64).reshape(-1, 5)
    base = np.zeros(capacity + 1, np.int64)
    for size, place in bases.items():
        base[size] = place

    before = by_task.select(
        "task",
        "length",
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            where = base[length] + batch.column(5).to_numpy()
            e = np.searchsorted(ends, where, side="right")
            j = where - (ends[e] - taken[e])
            size, first, _, each, offset = (spec[e, k] for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first + j // each), pa.array(offset + j % each * size)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("rank")).alias("rank")
    )
    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
