"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are fitted on a bounded sample: vectors least by a hash of their value,
thinned so that no two pivots are alike (a dense group then has few pivots of its own, and its
members agree on their order). Every vector is described by its ``depth`` nearest pivots in order,
and posted to inverted lists, one per set of ``shared`` of those pivots: two vectors meet in a list
exactly when they share that many. What meets is verified by its cosine in double precision, so no
pair below the threshold is linked. Recall against brute force is measured in the tests.

Equal vectors are one before retrieval, with their number; n_links counts them all. Lists longer
than a block are cut into blocks by a hash, and the blocks of a list meet in pairs, so no task
gathers a list and nothing is dropped from long ones. A pair that meets in several lists counts in
the first of them only, which both sides can tell from their descriptions, so pairs are never
shuffled; blocks send on sums of links and a spanning forest of theirs.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do
vectors of different lengths with each other. Rows that repeat an id are one row (the vector that is
least by hash stands). A null id is an id. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import changes, cut, whole_groups
from .components import components

BLOCK = 256
GROUP = ("width", "list", "left", "right")


def fit_pivots(sample: np.ndarray, most: int, alike: float = 0.7) -> np.ndarray:
    """At most ``most`` unit vectors of the sample, in its order, none ``alike`` an earlier one."""
    chosen = np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    for at in range(0, len(sample), 256):
        block = sample[at : at + 256]
        if len(chosen):
            block = block[(block @ chosen.T).max(axis=1) < alike]
        keep: list[int] = []
        near = block @ block.T
        for i in range(len(block)):
            if all(near[i, j] < alike for j in keep):
                keep.append(i)
        chosen = np.concatenate([chosen, block[keep]])[:most]
        if len(chosen) == most:
            break
    return chosen


def _made_pivots(width: int, count: int) -> np.ndarray:
    """Reference points for a length of which the sample has too few vectors."""
    points = np.random.default_rng(width).normal(size=(count, width))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest component first."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _list_key(pivots: np.ndarray) -> np.ndarray:
    """One number for each row of rising pivot numbers."""
    key = np.zeros(pivots.shape[:-1], np.int64)
    for j in range(pivots.shape[-1]):
        key = key * 4096 + pivots[..., j]
    return key


def _matrix(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the lengths of its lists."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(col.offsets.to_numpy())


def _describe(vectors: DataFrame, pivots: dict[int, np.ndarray], depth: int) -> DataFrame:
    """Adds ``near``: the numbers of the nearest pivots, nearest first."""
    least = 2 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = dict(pivots)
        for batch in batches:
            flat, width = _matrix(batch, "embedding")
            ends = np.cumsum(width)
            near = np.zeros((len(width), depth), np.int32)
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                rows = unit(flat[(ends[own] - w)[:, None] + np.arange(w)])
                if len(made.get(w, ())) < least:
                    made[w] = _made_pivots(int(w), max(least, 64))
                far = -(rows @ made[w].T)
                first = np.argpartition(far, depth - 1, axis=1)[:, :depth]
                order = np.argsort(np.take_along_axis(far, first, axis=1), axis=1)
                near[own] = np.take_along_axis(first, order, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(width) + 1, dtype=np.int32) * depth), pa.array(near.ravel()))],
                [*batch.schema.names, "near"],
            )

    types = ", ".join(f"{k} {v}" for k, v in vectors.dtypes)
    return vectors.mapInArrow(run, f"{types}, near array<int>")


def _postings(described: DataFrame, depth: int, shared: int) -> DataFrame:
    """rep, list: one row per vector and set of ``shared`` of its nearest pivots."""
    places = np.array(list(itertools.combinations(range(depth), shared)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(1).to_numpy()
            near = np.sort(batch.column(2).flatten().to_numpy().reshape(-1, depth), axis=1).astype(np.int64)
            keys = _list_key(near[:, places])
            rep = np.repeat(np.arange(len(near)), len(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rep)), pa.array(np.repeat(width, len(places))), pa.array(keys.ravel())], ["rep", "width", "list"]
            )

    id_type = dict(described.dtypes)["rep"]
    return described.select("rep", F.size("embedding").cast("long").alias("width"), "near").mapInArrow(run, f"rep {id_type}, width bigint, list bigint")


def _verify(groups: DataFrame, threshold: float, shared: int) -> DataFrame:
    """rep, links (to add to its sum), root (null, or a vector that it is connected to).

    Rows come sorted by (width, list, left, right); ``side`` tells the block that a row is of.
    """
    id_type = dict(groups.dtypes)["rep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, GROUP):
            ids, links, roots = [], [], []
            rep = table.column("rep").to_numpy()
            number = table.column("n").to_numpy()
            side = table.column("side").to_numpy()
            near = np.sort(_list_values(table, "near").reshape(len(rep), -1), axis=1).astype(np.int64)
            flat, width = _list_values(table, "embedding").astype(np.float64), table.column("width").to_numpy()
            ends = np.cumsum(width)
            lists = table.column("list").to_numpy()
            cuts = np.flatnonzero(np.append(True, changes(table, GROUP))).tolist() + [len(rep)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                x = unit(flat[ends[a] - width[a] : ends[b - 1]].reshape(b - a, -1))
                near_enough = np.triu(x @ x.T >= threshold, 1)
                s = side[a:b]
                if s[0] != s[-1]:  # two blocks: only pairs across
                    near_enough &= s[:, None] != s[None, :]
                i, j = np.nonzero(near_enough)
                if not len(i):
                    continue
                same = (near[a:b][i][:, :, None] == near[a:b][j][:, None, :]).any(axis=2)
                first = np.sort(np.where(same, near[a:b][i], 1 << 20), axis=1)[:, :shared]
                own = _list_key(first) == lists[a]
                i, j = i[own], j[own]
                if not len(i):
                    continue
                n = number[a:b]
                total = np.bincount(i, n[j], b - a) + np.bincount(j, n[i], b - a)
                root = _roots(i, j, b - a)
                hit = np.flatnonzero(total)
                ids.append(rep[a:b][hit])
                links.append(total[hit].astype(np.int64))
                roots.append(rep[a:b][root[hit]])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(links)), pa.array(np.concatenate(roots))], ["rep", "links", "root"]
                )

    return groups.mapInArrow(run, f"rep {id_type}, links bigint, root {id_type}")


def _list_values(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least place that each place is connected to by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        then = root.copy()
        np.minimum.at(then, i, low)
        np.minimum.at(then, j, low)
        then = then[then]
        if (then == root).all():
            return root
        root = then


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.95,
    depth: int = 7,
    shared: int = 3,
    most_pivots: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (the least id of its component).

    There are four pivots for the square root of the number of different vectors, at least 64 and at
    most ``most_pivots``, fitted on at most four times as many vectors.
    """
    v = F.col(vector_col)
    # Zeros are written one way, so that equal vectors are equal bytes.
    valid = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.when(valid, F.transform(v, lambda x: x + 0)).alias("embedding"),
    ).select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))).alias("h"))
    ids = cut(rows.groupBy("vec_id").agg(F.min("h").alias("h")))
    classes = ids.where(F.col("h").isNotNull()).groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    one = rows.where(F.col("embedding").isNotNull()).dropDuplicates(["vec_id", "h"]).withColumnRenamed("h", "own")
    known = cut(classes.join(one, (F.col("rep") == F.col("vec_id")) & (F.col("h") == F.col("own"))).select("rep", "n", "h", "embedding"))

    count = known.count()
    most = min(most_pivots, max(64, int(4 * count**0.5)))
    by_width: dict[int, list] = {}
    for r in known.orderBy("h").limit(4 * most).select("embedding").collect():
        by_width.setdefault(len(r.embedding), []).append(r.embedding)
    pivots = {w: fit_pivots(unit(np.array(x, np.float64)), most) for w, x in by_width.items()}

    described = cut(_describe(known.select("rep", "n", "embedding"), pivots, depth))
    postings = _postings(described, depth, shared)
    lengths = postings.groupBy("width", "list").agg(F.count("*").alias("length")).where("length > 1")
    posted = postings.join(lengths, ["width", "list"]).select("rep", "width", "list", F.ceil(F.col("length") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    placed = posted.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("rep", "width", "list", "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    groups = placed.join(described, "rep").repartition("width", "list", "left", "right").sortWithinPartitions("width", "list", "left", "right", "side")
    linked = cut(_verify(groups, threshold, shared))

    sums = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = linked.where(F.col("root") != F.col("rep")).select(F.col("rep").alias("u"), F.col("root").alias("v"))
    found = components(edges)
    told = classes.join(sums, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    told = told.select("h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = ids.join(told, "h", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        F.col("vec_id"), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
